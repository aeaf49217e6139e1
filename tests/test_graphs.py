"""Wirings, traversal, canonical keys and sampling against facts derived by hand."""

from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from walkweave.functions.arrays import collapse_nulls, min_rotation, reverse_complement
from walkweave.operators import canonical as C
from walkweave.operators import graph as G
from walkweave.operators import pairing as P
from walkweave.operators import sampling as S
from walkweave.operators.skew import heavy_keys, number_rows, running_sum
from walkweave.operators.traversal import traverse, traverse_joins
from walkweave.session import cut
from walkweave.sources.generators import RECIPROCAL, THREE_WAY, bridge_walk, walk_steps


def wired(spark, walks, circular=False):
    steps = walk_steps(spark, walks, circular).withColumn("gid", F.lit(0).cast("long"))
    ext = cut(G.subids(G.walk_external(steps, ["gid"]), ["gid"]))
    return steps, ext, cut(G.wiring(ext, ["gid"]))


def every_wiring(spark, wiring):
    """All re-pairings of a small graph as samples."""
    rows = wiring.orderBy("id").collect()
    nodes = sorted({r["n"] for r in rows})
    rights = {n: [r["right"] for r in rows if r["n"] == n] for n in nodes}
    out = []
    for s, choice in enumerate(product(*[list(permutations(rights[n])) for n in nodes])):
        pick = dict(zip(nodes, choice))
        out += [(s, r["id"], r["n"], r["left"], pick[r["n"]][r["copy"] - 1]) for r in rows]
    return spark.createDataFrame(out, "gid long, id long, n int, left long, right long")


def karyotypes(steps):
    walks = steps.select(F.col("gid").alias("kar_id"), F.col("walk").alias("walk_id"), "circular", "pos", "n", "node")
    return walks, C.karyotype_keys(C.walk_keys(walks))


def test_three_way_graph(spark):
    _, ext, wiring = wired(spark, THREE_WAY)
    nodes = {r["n"]: r["c"] for r in wiring.groupBy("n").agg(F.count("*").alias("c")).collect()}
    assert nodes == {n: 3 if n in (2, 5, 8) else 2 for n in range(1, 10)}
    edges = {(r["n1"], r["n2"]): (r["cn"], r["type"]) for r in ext.filter("type <> 'LOO'").collect()}
    assert sum(t == "ALT" for _, t in edges.values()) == 3 and len(edges) == 9
    assert edges[(1, 2)] == (2, "REF") and edges[(2, 5)] == (1, "ALT")
    assert ext.filter("type = 'LOO'").agg(F.sum("cn")).first()[0] == 12
    assert wiring.count() == 21


def test_three_way_enumeration(spark):
    _, _, wiring = wired(spark, THREE_WAY)
    steps = traverse(every_wiring(spark, wiring))
    walks, keys = karyotypes(steps)
    keys = cut(keys)
    assert keys.count() == 13824
    classes = [r["c"] for r in keys.groupBy(*C.KEY).agg(F.count("*").alias("c")).collect()]
    assert sorted(classes) == [512, 1024, 1024, 1024, 2048, 2048, 2048, 4096]
    ring = keys.filter("circ").groupBy(*C.KEY).agg(F.count("*").alias("c"), F.min("kar_id").alias("k")).collect()
    assert [r["c"] for r in ring] == [512] and ring[0]["len"] == 7
    nodes = [r["node"] for r in walks.filter((F.col("kar_id") == ring[0]["k"]) & F.col("circular")).orderBy("pos").collect()]
    assert sorted(map(abs, nodes)) == [2, 5, 8]


@pytest.mark.parametrize("geometry", ["cis1", "cis2", "trans"])
def test_reciprocal_duplications_share_one_graph(spark, geometry):
    _, _, wiring = wired(spark, RECIPROCAL[geometry])
    _, keys = karyotypes(traverse(every_wiring(spark, wiring)))
    classes = [r["c"] for r in keys.groupBy(*C.KEY).agg(F.count("*").alias("c")).collect()]
    assert wiring.count() == 14 and sorted(classes) == [64, 128, 128, 256]


def test_join_and_batch_traversal_agree(spark):
    walks = [bridge_walk(8, 5, 42)]
    _, _, wiring = wired(spark, walks)
    drawn = S.sample_wirings(wiring, 50, seed=1)
    flat = cut(drawn.select(S.sample_id(F.col("gid"), F.col("sample"), 50).alias("gid"), "id", "n", "left", "right"))
    a, b = traverse(flat), traverse_joins(flat, wiring.count())
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 50 * wiring.count()
    mixed = traverse(flat, local_rows=1)
    assert mixed.exceptAll(a).count() == 0


def test_tandem_and_fold_back(spark):
    rows = [(0, 1, 7, 1, 1), (1, 1, 3, 10, 11), (1, 2, 3, 12, 11)]
    w = spark.createDataFrame(rows, "gid long, id long, n int, left long, right long")
    got = {(r["gid"], r["circular"], r["n"]) for r in traverse(w).collect()}
    assert got == {(0, True, 1), (1, False, 2)}
    fold = [r["node"] for r in traverse(w).filter("gid = 1").orderBy("pos").collect()]
    assert fold == [3, -3]
    assert traverse_joins(w, 2).exceptAll(traverse(w)).count() == 0


def test_walk_external_equals_balancing(spark):
    steps, _, _ = wired(spark, THREE_WAY + ([2, 5, 8],), [False] * 6 + [True])
    direct = G.walk_external(steps, ["gid"])
    balanced = G.graph_external(G.walk_nodes(steps, ["gid"]), G.walk_edges(steps, ["gid"]), ["gid"])
    cols = balanced.columns
    assert direct.select(cols).exceptAll(balanced).count() == 0 and direct.count() == balanced.count()


def test_split_paths_equal_plain_ones(spark):
    walks = [list(range(1, 41)), [-v for v in range(1, 38)], [5, 6, 7]]
    rings = [False, True, True]
    steps = walk_steps(spark, walks, rings)
    for k in (2, 3, 4):
        a, b = G.with_next(steps, k), G.with_next(steps, k, block=5)
        assert a.exceptAll(b).count() == 0 and a.count() == b.count() == steps.count()
    x = running_sum(steps, ["walk_id"], F.abs("node"), "s")
    y = running_sum(steps, ["walk_id"], F.abs("node"), "s", split=True, block=7)
    assert x.exceptAll(y.select(x.columns)).count() == 0
    raw = steps.select("walk_id", "node", (F.col("pos") * 3).alias("o"))
    p = number_rows(raw, "walk_id", F.floor(F.col("o") / 10), [F.col("o")])
    for hot in ([0], None):
        q = number_rows(raw, "walk_id", F.floor(F.col("o") / 10), [F.col("o")], hot)
        assert p.exceptAll(q.select(p.columns)).count() == 0
    assert heavy_keys(raw, "walk_id", min_rows=10) == [0, 1] or set(heavy_keys(raw, "walk_id", min_rows=10)) == {0, 1}
    ext = G.walk_external(steps.withColumn("gid", F.lit(0)), ["gid"])
    one, two = G.subids(ext, ["gid"]), G.subids(ext, ["gid"], split=True)
    assert one.exceptAll(two.select(one.columns)).count() == 0
    w1, w2 = G.wiring(one, ["gid"]), G.wiring(one, ["gid"], split=True)
    assert w1.exceptAll(w2).count() == 0


ORBITS = [
    ([1, 2, 3, 4], [-4, -3, -2, -1], False, False, True),
    ([3, 1, 4, 1, 5], [-1, -4, -1, -3, -5], True, True, True),
    ([1, 2, 3, 4, 5], [1, 2, 3, 5, 4], True, True, False),
    ([1, 2, 3], [1, 2, 3], False, True, False),
    ([1, 2, 3], [1, 3, 2], False, False, False),
]


@pytest.mark.parametrize("a,b,ca,cb,same", ORBITS)
def test_walk_keys(spark, a, b, ca, cb, same):
    steps = walk_steps(spark, [a, b], [ca, cb])
    for limit in (256, 0):
        keys = C.walk_keys(steps, array_steps=limit)
        assert (keys.select(*C.KEY).distinct().count() == 1) is same


def test_ring_orbit_is_one_class(spark):
    base = [7, 2, 9, 4, 1]
    rc = [-v for v in reversed(base)]
    orbit = [w[k:] + w[:k] for w in (base, rc) for k in range(5)]
    steps = walk_steps(spark, orbit, True)
    for limit in (256, 0):
        assert C.walk_keys(steps, array_steps=limit).select(*C.KEY).distinct().count() == 1
        canon = C.canonical_steps(steps, array_steps=limit)
        got = {tuple(r["nodes"]) for r in C.collect_walks(canon).collect()}
        assert got == {min(tuple(w) for w in orbit)}
    first = spark.createDataFrame([(base,)], "w array<int>")
    assert first.select(min_rotation("w")).first()[0] == [1, 7, 2, 9, 4]
    assert first.select(reverse_complement(F.col("w"))).first()[0] == rc


def test_karyotype_key_ignores_walk_order(spark):
    a = walk_steps(spark, [[1, 2, 3], [4, 5], [6, 7, 8]], kar_id=1)
    b = walk_steps(spark, [[6, 7, 8], [-5, -4], [1, 2, 3]], kar_id=2)
    c = walk_steps(spark, [[6, 7, 8], [4, 5], [4, 5], [1, 2, 3]], kar_id=3)
    keys = C.karyotype_keys(C.walk_keys(a.unionByName(b).unionByName(c)))
    groups = sorted(r["m"] for r in C.representatives(keys, "kar_id").select("kar_id", F.col("members").alias("m")).collect())
    assert groups == [1, 2, 2]


def test_fnv_key(spark):
    rows = [(1, [1, 2, 3], False), (2, [-3, -2, -1], False), (3, [1, 2, 3], True)]
    walks = spark.createDataFrame(rows, "kar_id int, nodes array<int>, circular boolean")
    got = {r["kar_id"]: r["hash"] for r in C.fnv_keys(walks).collect()}
    assert got[1] == got[2] != got[3] and len(got[1]) == 16
    empty = spark.createDataFrame([([],)], "w array<struct<nodes array<int>, circular boolean>>")
    assert empty.select(C.fnv_key("w")).first()[0] == "0" * 16
    h = 0xCBF29CE484222325
    for entry in ([-3, -2, -1], [1, 2, 3]):
        for byte in b"\xfeL" + b"".join(v.to_bytes(4, "little", signed=True) for v in entry):
            h = ((h ^ byte) * 0x100000001B3) % 2**64
    assert got[1] == f"{h:016x}"


def test_sampling_is_uniform_and_covers(spark):
    _, _, wiring = wired(spark, THREE_WAY)
    steps = cut(S.sample_walks(wiring, 2000, seed=3, unique=False))
    assert {r["c"] for r in steps.groupBy("kar_id").agg(F.count("*").alias("c")).collect()} == {21}
    kars = S.unique_karyotypes(steps).collect()
    shares = sorted(r["members"] / 2000 for r in kars)
    expected = sorted(c / 13824 for c in [512, 1024, 1024, 1024, 2048, 2048, 2048, 4096])
    assert len(kars) == 8 and all(abs(a - b) < 0.035 for a, b in zip(shares, expected))
    again = S.sample_walks(wiring.repartition(7), 2000, seed=3, unique=False)
    assert again.exceptAll(steps).count() == 0
    frozen = S.sample_wirings(wiring, 5, seed=3, frozen=[2, 5, 8]).filter("n in (2, 5, 8)")
    base = wiring.select("id", F.col("right").alias("r0"))
    assert frozen.join(base, "id").filter("right <> r0").count() == 0
    plain, split = S.sample_wirings(wiring, 3, 9), S.sample_wirings(wiring, 3, 9, split=True)
    assert plain.exceptAll(split).count() == 0


def test_markov_moves_change_two_rights(spark):
    _, _, wiring = wired(spark, THREE_WAY)
    states = cut(S.chain_wirings(wiring, S.transpositions(wiring, 3, 4, seed=2), 4))
    prev = states.select("gid", "chain", (F.col("step") + 1).alias("step"), "id", F.col("right").alias("r0"))
    changed = states.join(prev, ["gid", "chain", "step", "id"]).groupBy("chain", "step").agg(
        F.sum((F.col("right") != F.col("r0")).cast("int")).alias("c")).collect()
    assert len(changed) == 12 and {r["c"] for r in changed} == {2}
    walks = S.markov_walks(wiring, 3, 4, seed=2)
    sizes = walks.groupBy("chain", "step").agg(F.count("*").alias("c"))
    assert {r["c"] for r in sizes.collect()} == {21}


def test_self_avoiding_chains(spark):
    _, _, wiring = wired(spark, THREE_WAY)
    walks = S.self_avoiding_chains(wiring, 4, 6, 3, seed=5)
    assert {r["c"] for r in walks.groupBy("chain", "step").agg(F.count("*").alias("c")).collect()} == {21}
    keys = C.karyotype_keys(C.walk_keys(walks.withColumn("kar_id", F.struct("gid", "chain", "step"))))
    shown = keys.select("kar_id.chain", "kar_id.step", *C.KEY).collect()
    chains = {}
    for r in shown:
        chains.setdefault(r["chain"], {})[r["step"]] = tuple(r[k] for k in C.KEY)
    assert sorted(chains) == [0, 1, 2, 3]
    for states in chains.values():
        assert sorted(states) == list(range(len(states))) and len(set(states.values())) == len(states)
    assert max(map(len, chains.values())) > 2 and len({s[0] for s in chains.values()}) > 1
    # a graph whose nodes have one copy each has no move
    still = wiring.filter("copy = 1").withColumn("right", F.col("left"))
    assert {r["step"] for r in S.self_avoiding_chains(still, 2, 3, 2, seed=5).select("step").distinct().collect()} <= {0}


def test_null_collapse(spark):
    df = spark.createDataFrame([([1, None, None, 2, None],)], "w array<int>")
    assert df.select(collapse_nulls(F.col("w"))).first()[0] == [1, None, 2, None]


def test_junction_classes(spark):
    rows = [(1, "right", 2, "left", 2, "REF"), (2, "left", 2, "right", 3, "ALT"), (1, "right", 3, "left", 1, "ALT")]
    edges = spark.createDataFrame(rows, "n1 int, n1_side string, n2 int, n2_side string, cn long, type string")
    nodes = spark.createDataFrame([(1, 4), (2, 5), (3, 4)], "node_id int, cn long")
    got = {r["node_id"]: r["cn_smooth"] for r in G.smoothed_cn(nodes, edges).collect()}
    assert got == {1: 4, 2: 3, 3: 4}
    assert G.repeated_junctions(edges.unionByName(edges.limit(1))).count() == 1


def test_pasted_junctions_balance_the_graph(spark):
    edges = spark.createDataFrame([(7, 1, "right", 2, "left", 2, "REF"), (7, 0, "right", 1, "left", 3, "LOO")], "gid long, n1 int, n1_side string, n2 int, n2_side string, cn long, type string")
    nodes = spark.createDataFrame([(7, 1, 3), (7, 2, 5)], "gid long, node_id int, cn long")
    loose = G.loose_ends(nodes, edges.filter("type <> 'LOO'"), ["gid"]).filter("cn > 0")
    ends = loose.select("gid", (F.col("node_id") * 2 + F.when(F.col("orientation") == "right", 1).otherwise(0)).cast("long").alias("end_id"), "cn")
    found = P.pair_loose_ends(ends, seed=1)
    whole, left = G.paste_junctions(nodes, edges, found, ["gid"])
    used = {}
    for r in whole.collect():
        for n, side in ((r["n1"], r["n1_side"]), (r["n2"], r["n2_side"])):
            used[n, side] = used.get((n, side), 0) + r["cn"]
        assert (r["n1"], r["n1_side"]) <= (r["n2"], r["n2_side"])
    odd = ends.agg(F.sum("cn")).first()[0] % 2
    assert sum(r["cn"] for r in left.collect()) == odd
    assert sum({(1, "left"): 3, (1, "right"): 3, (2, "left"): 5, (2, "right"): 5}[k] - v for k, v in used.items()) == odd
    again, _ = G.paste_junctions(nodes, whole, found.limit(0), ["gid"])
    assert again.exceptAll(whole).isEmpty()


def test_pasted_graphs_read_their_walks_once(spark, sf, monkeypatch):
    from walkweave.operators import pairing
    from walkweave.plans import inference_queries as queries
    from walkweave.plans import tables

    walks, seen = tables.customer_walks(spark, sf), []
    external = G.walk_external(walks.df, ["kar_id"], 10)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(G.external_nodes(external, ["kar_id"])) == rows(G.walk_nodes(walks.df, ["kar_id"]))
    loose = queries._loose_ends(external.withColumnRenamed("kar_id", "gid"))
    once, twice = (rows(pairing.pair_loose_ends(loose, seed=5, split=split)) for split in (False, True))
    assert once == twice and len(once) > 50 and not pairing.many_ends(loose)
    monkeypatch.setattr(pairing, "MIN_HOT_ROWS", 3)
    assert pairing.many_ends(loose)
    monkeypatch.setattr(queries.T, "customer_walks", lambda *a: seen.append(a) or walks)
    assert queries.pasted_graphs(spark, sf).count() > 50 and len(seen) == 1

"""Simulation, statistics, distances and pairing against brute force."""

import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from walkweave.functions import stats
from walkweave.operators import amplicon as A
from walkweave.operators import collapse as CO
from walkweave.operators import contact as K
from walkweave.operators import distance as D
from walkweave.operators import graph as G
from walkweave.operators import intervals as I
from walkweave.operators import likelihood as L
from walkweave.operators import pairing as P
from walkweave.operators import reads as R
from walkweave.plans import pipelines as PL
from walkweave.sources.calibration import SYNTHETIC, cubic_spline
from walkweave.sources.generators import THREE_WAY, segments, walk_steps

W = 100_000


def value(area, d):
    if d == 0:
        return math.exp(SYNTHETIC.diagonal[0] + SYNTHETIC.diagonal[1] * math.log(area))
    if d > 1e8:
        return area * math.exp(SYNTHETIC.log_density_at(math.log(1e8))) * 1e8 / d
    return area * math.exp(SYNTHETIC.log_density_at(math.log(d)))


def brute_map(walks, rings, per_node):
    """Matrix product form: lift the symmetric walk matrix to the reference and keep the upper triangle."""
    tile = W // per_node
    out = {}
    for walk, ring in zip(walks, rings):
        ids = []
        for v in walk:
            own = [(abs(v) - 1) * per_node + k + 1 for k in range(per_node)]
            ids += own if v > 0 else own[::-1]
        mids = [(k + 0.5) * tile + 0.5 for k in range(len(ids))]
        total = tile * len(ids)
        for a in range(len(ids)):
            for b in range(len(ids)):
                d = abs(mids[a] - mids[b])
                d = min(d, total - d) if ring else d
                if ids[a] <= ids[b]:
                    key = (ids[a], ids[b])
                    out[key] = out.get(key, 0.0) + value(tile * tile, d)
    return out


@pytest.mark.parametrize("per_node", [1, 4])
def test_pixels_match_matrix_form(spark, per_node):
    walks, rings = [*THREE_WAY, [2, 5, -8, 2]], [False] * 6 + [True]
    nodes = segments(spark, 9, W, 3)
    steps = walk_steps(spark, walks, rings)
    tiles = I.tile_nodes(nodes, W // per_node)
    want = brute_map(walks, rings, per_node)
    for split, pair_steps in ((False, 256), (True, 2)):
        got = {(r["i"], r["j"]): r["value"] for r in K.walk_pixels(steps, nodes, tiles, split=split, pair_steps=pair_steps).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_map_shape_and_invariance(spark):
    nodes = segments(spark, 9, 1_000_000, 3)
    steps = walk_steps(spark, THREE_WAY)
    tiles, full = PL.forward_simulate(steps, nodes, 100_000, depth=2)
    assert tiles.count() == 90 and full.count() == 4095
    flipped = walk_steps(spark, [[-v for v in reversed(w)] for w in reversed(THREE_WAY)])
    _, other = PL.forward_simulate(flipped, nodes, 100_000, depth=4)
    both = full.join(other.select("id", F.col("value").alias("v2")), "id")
    assert both.filter(F.abs(F.col("v2") - 2 * F.col("value")) > 1e-6 * F.col("v2")).count() == 0
    ids = full.select("id", "i", "j").orderBy("i", "j").collect()
    assert [r["id"] for r in ids] == list(range(1, 4096))


def test_half_nodes_and_footprint(spark):
    nodes = spark.createDataFrame([(1, "1", 1, 5, 1), (2, "1", 6, 9, 2)], "node_id int, seqnames string, start long, end long, cn int")
    got = [(r["start"], r["end"], r["side"]) for r in I.half_nodes(nodes).orderBy("tile_id").collect()]
    assert got == [(1, 2, "left"), (3, 5, "right"), (6, 7, "left"), (8, 9, "right")]
    rng = random.Random(1)
    spans = [("1", s, s + rng.randint(0, 30)) for s in (rng.randint(1, 900) for _ in range(60))]
    covered = sorted({p for _, s, e in spans for p in range(s, e + 1)})
    want, start = [], None
    for k, p in enumerate(covered):
        start = p if start is None else start
        if k + 1 == len(covered) or covered[k + 1] != p + 1:
            want.append((start, p))
            start = None
    df = spark.createDataFrame(spans, "seqnames string, start long, end long")
    for width in (16, 1 << 20):
        assert sorted((r["start"], r["end"]) for r in I.footprint(df, bin_width=width).collect()) == want


def test_overlap_join_matches_nested_loop(spark):
    rng = random.Random(2)
    make = lambda n: [(k, str(rng.randint(1, 2)), s, s + rng.randint(0, 80)) for k, s in enumerate(rng.randint(1, 500) for _ in range(n))]
    a, b = make(40), make(30)
    want = sorted((x[0], y[0], max(x[2], y[2]), min(x[3], y[3])) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    da = spark.createDataFrame(a, "x int, seqnames string, start long, end long")
    db = spark.createDataFrame(b, "y int, seqnames string, start long, end long")
    for width in (16, 64, 1024):
        got = sorted((r["x"], r["y"], r["start"], r["end"]) for r in I.overlap_join(da, db, width).collect())
        assert got == want
    semi = {r["x"] for r in I.overlap_semi(da, db, 64, "x").collect()}
    assert semi == {w[0] for w in want}


def test_rebin_conserves_mass(spark):
    src = spark.createDataFrame([(k + 1, "1", k * 7 + 1, k * 7 + 7) for k in range(6)], "tile_id int, seqnames string, start long, end long")
    dst = spark.createDataFrame([(k + 1, "1", k * 5 + 1, k * 5 + 5) for k in range(9)], "tile_id int, seqnames string, start long, end long")
    px = spark.createDataFrame([(i, j, float(i * 10 + j)) for i in range(1, 7) for j in range(i, 7)], "i int, j int, value double")
    out = I.rebin(px, src, dst, 8)
    assert math.isclose(out.agg(F.sum("value")).first()[0], px.agg(F.sum("value")).first()[0], rel_tol=1e-12)
    back = I.rebin(px, src, src, 8)
    assert back.join(px.withColumnRenamed("value", "v"), ["i", "j"]).filter(F.abs(F.col("v") - F.col("value")) > 1e-9).count() == 0


def test_statistics(spark):
    rows = [(float(x), m) for x in (0, 1, 2, 7, 40, 900) for m in (0.3, 2.0, 55.0)]
    df = spark.createDataFrame(rows, "x double, m double").select(
        "x", "m", stats.nb_logpmf(F.col("x"), F.col("m"), 2).alias("nb2"), stats.nb_logpmf(F.col("x"), F.col("m"), 3.5).alias("nb"),
        stats.poisson_logpmf(F.col("x"), F.col("m")).alias("po"), stats.nb_upper_tail(F.col("x"), F.col("m"), 2).alias("t2"),
        stats.nb_upper_tail(F.col("x"), F.col("m"), 4).alias("t4"), stats.count_logpmf(F.col("x") + 0.5, F.lit(0.0), 2).alias("z"))

    def nb(x, m, r):
        return math.lgamma(x + r) - math.lgamma(r) - math.lgamma(x + 1) + r * math.log(r / (r + m)) + x * math.log(m / (r + m))

    for r in df.collect():
        x, m = r["x"], r["m"]
        assert math.isclose(r["nb2"], nb(x, m, 2), rel_tol=1e-10, abs_tol=1e-10)
        assert math.isclose(r["nb"], nb(x, m, 3.5), rel_tol=1e-10, abs_tol=1e-9)
        assert math.isclose(r["po"], x * math.log(m) - m - math.lgamma(x + 1), rel_tol=1e-10, abs_tol=1e-9)
        for size, col in ((2, "t2"), (4, "t4")):
            tail = 1 - sum(math.exp(nb(k, m, size)) for k in range(int(x)))
            assert abs(r[col] - tail) < 1e-9
        assert r["z"] == 0


def test_benjamini_hochberg(spark):
    rng = random.Random(4)
    p = [round(rng.random() ** 3, 2) for _ in range(300)]
    order = sorted(range(300), key=lambda k: -p[k])
    want, low = [0.0] * 300, 1.0
    for back, k in enumerate(order):
        low = min(low, p[k] * 300 / (300 - back))
        want[k] = low
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    got = {r["k"]: r["fdr"] for r in L.benjamini_hochberg(df).collect()}
    by_p = {}
    for k in range(300):
        by_p[p[k]] = min(by_p.get(p[k], 1.0), want[k])
    assert all(abs(got[k] - by_p[p[k]]) < 1e-12 for k in range(300))


@pytest.mark.parametrize("theta", [2, 0, 1.5])
def test_noise_moments_and_partitioning(spark, theta):
    px = spark.createDataFrame([(i, 1, m) for i, m in enumerate([0.0, 0.7, 12.0, 450.0])], "i int, j int, value double")
    drawn = L.noisy_maps(px, 4000, theta, seed=8)
    stat = {r["i"]: (r["m"], r["v"]) for r in drawn.groupBy("i").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).collect()}
    for i, m in enumerate([0.0, 0.7, 12.0, 450.0]):
        var = m + (m * m / theta if theta else 0)
        assert abs(stat[i][0] - m) <= 5 * math.sqrt(var / 4000) + 1e-12
        if m:
            assert abs(stat[i][1] / var - 1) < 0.25
    again = L.noisy_maps(px.repartition(3), 4000, theta, seed=8)
    assert again.exceptAll(drawn).count() == 0


def test_spline_reproduces_cubics():
    x = np.linspace(0, 3, 7)
    fit = cubic_spline(x, x**3 - 2 * x)
    for v in (-0.5, 0.3, 1.7, 2.9, 3.4):
        assert abs(fit.log_density_at(v) - (v**3 - 2 * v)) < 1e-9


def dp_cost(x, y, w):
    best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            if i == 0 or j == 0:
                best[i][j] = sum(w[abs(v)] for v in x[:i]) + sum(w[abs(v)] for v in y[:j])
                continue
            a, b = w[abs(x[i - 1])], w[abs(y[j - 1])]
            best[i][j] = min(best[i - 1][j] + a, best[i][j - 1] + b, best[i - 1][j - 1] + (0 if x[i - 1] == y[j - 1] else a + b))
    return best[-1][-1]


def test_alignment_and_edit_distance(spark):
    rng = random.Random(5)
    nodes = spark.createDataFrame([(n, rng.randint(1, 9) * 10) for n in range(1, 8)], "node_id int, width long")
    w = {r["node_id"]: float(r["width"]) for r in nodes.collect()}
    kars = {k: [[rng.choice([-1, 1]) * rng.randint(1, 7) for _ in range(rng.randint(1, 7))] for _ in range(rng.randint(1, 5))] for k in range(12)}
    kars[11] = [list(v) for v in kars[10]]
    steps = None
    for k, walks in kars.items():
        one = walk_steps(spark, walks, kar_id=k)
        steps = one if steps is None else steps.unionByName(one)
    pairs = [(k, k, k + 1) for k in range(11)] + [(100 + k, k + 1, k) for k in range(11)]
    got = {r["pair_id"]: r["edit"] for r in D.edit_distance(
        spark.createDataFrame(pairs, "pair_id long, kar_a long, kar_b long"), steps, nodes).collect()}

    def both(x, y):
        return min(dp_cost(x, y, w), dp_cost(x, [-v for v in reversed(y)], w))

    for pid, a, b in pairs:
        xs, ys = kars[a], kars[b]
        n = max(len(xs), len(ys))
        xs, ys = xs + [[]] * (n - len(xs)), ys + [[]] * (n - len(ys))
        cost = [[both(x, y) for y in ys] for x in xs]
        want = min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)))
        assert math.isclose(got[pid], want, abs_tol=1e-9)
    assert got[10] == 0 and got[3] == got[103]


def test_read_words_by_enumeration(spark):
    widths = {1: 3, 2: 5, 3: 2, 4: 4}
    nodes = spark.createDataFrame(list(widths.items()), "node_id int, width long")
    walks, rings = [[1, -2, 3, 2], [4, 1, 3], [2]], [False, True, True]
    for length in (1, 4, 9, 30):
        want = {}
        for walk, ring in zip(walks, rings):
            line = [k for k, v in enumerate(walk) for _ in range(widths[abs(v)])]
            size = len(line)
            read = min(length, size) if ring else length
            for s in range(0 if ring else 1 - length, size):
                if ring:
                    idx = [line[p % size] + len(walk) * (p // size) for p in range(s, s + read)]
                else:
                    idx = [line[p] for p in range(max(s, 0), min(s + read, size))]
                word = [walk[k % len(walk)] for k in sorted(set(idx))]
                for wd in (word, [-v for v in reversed(word)]):
                    key = "|".join(map(str, wd))
                    want[key] = want.get(key, 0) + 1
        steps = walk_steps(spark, walks, rings)
        for split in (False, True):
            for widest in (64, 0):  # carried along whole, or known by prefix hashes
                got = {r["word"]: r["nums"] for r in R.read_words(steps, nodes, length, split=split, block=2 if split else 64, widest=widest).collect()}
                assert got == want


def test_kmers_by_enumeration(spark):
    walks, rings = [[1, -2, 3, 2], [4, 1, 3], [2]], [False, True, True]
    for k in (1, 2, 3, 4):
        want = {}
        for walk, ring in zip(walks, rings):
            n = len(walk)
            starts = range(n) if ring and k <= n + 1 else range(n - k + 1)
            for s in starts:
                km = [walk[(s + t) % n] for t in range(k)]
                for v in (km, [-x for x in reversed(km)]):
                    want["|".join(map(str, v))] = want.get("|".join(map(str, v)), 0) + 1
        got = {r["kmer"]: r["count"] for r in R.kmers(walk_steps(spark, walks, rings), k).collect()}
        assert got == want


def fewest(cn):
    """Least number of distinct junctions by breadth-first search over residual states."""
    level, seen, depth = {tuple(sorted(cn))}, set(), 0
    while True:
        if () in level:
            return depth
        seen |= level
        nxt = set()
        for s in level:
            i = len(s) - 1
            for j in range(i):
                for w in range(1, s[j] + 1):
                    r = list(s)
                    r[i] -= w
                    r[j] -= w
                    nxt.add(tuple(sorted(v for v in r if v)))
            for w in range(1, s[i] // 2 + 1):
                r = list(s)
                r[i] -= 2 * w
                nxt.add(tuple(sorted(v for v in r if v)))
        level, depth = nxt - seen, depth + 1


def test_loose_end_pairing_is_minimal(spark):
    rng = random.Random(6)
    graphs = {g: [rng.randint(1, 6) for _ in range(rng.randint(1, 6))] for g in range(25)}
    rows = [(g, k, c) for g, cn in graphs.items() for k, c in enumerate(cn)]
    out = P.pair_loose_ends(spark.createDataFrame(rows, "gid long, end_id long, cn long"), seed=2).collect()
    for g, cn in graphs.items():
        mine = [r for r in out if r["gid"] == g]
        used = [0] * len(cn)
        for r in mine:
            used[r["a"]] += r["cn"]
            used[r["b"]] += r["cn"]
        lost = [c - u for c, u in zip(cn, used)]
        assert sum(lost) == sum(cn) % 2 and all(v in (0, 1) for v in lost)
        assert len({(r["a"], r["b"]) for r in mine}) == len(mine) == fewest([u for u in used if u])


def test_bounded_pairing_reports_open_graphs(spark):
    rows = [(0, k, 2 * k + 3) for k in range(8)] + [(1, 0, 2), (1, 1, 2)]
    loose = spark.createDataFrame(rows, "gid long, end_id long, cn long")
    done, late = P.pair_loose_ends_bounded(loose, 1, 100_000)
    assert late.count() == 0 and done.exceptAll(P.pair_loose_ends(loose, 1)).count() == 0
    done, late = P.pair_loose_ends_bounded(loose, 1, 0)
    assert [r["gid"] for r in late.collect()] == [0] and {r["gid"] for r in done.collect()} == {1}


def test_collapse_drops_detours(spark):
    nodes = segments(spark, 9, 10, 3)
    rows = CO.band_rows(nodes, None, 64).withColumn("width", F.when(F.col("node_id") == 7, 3).otherwise(F.col("width")))
    steps = walk_steps(spark, [[1, 2, 3, 7, 4, 5], [1, 2, 7, -8, 7, 3], [-3, -2, 8, 9]])
    for split, block in ((False, 1 << 16), (True, 2)):
        out = CO.collapse_walks(steps, rows, 11, split=split, block=block)
        got = {r["walk_id"]: r["bands"] for r in CO.collapsed_text(out).collect()}
        assert got[0] == "1|2|3|4|5" and got[2] == "-3|-2|8|9"
        assert got[1] == "1|2|NA"
        assert CO.collapsed_keys(out, ["walk_id"], split).select("len", "h1", "h2").distinct().count() == 3


def test_entropy_and_peeling(spark):
    steps = walk_steps(spark, [[1, 2], [1, 2], [2, 3]])
    amp = spark.createDataFrame([(2,)], "node_id int")
    assert math.isclose(A.amplicon_entropy(steps, amp).first()["entropy"], math.log(3))
    nodes = segments(spark, 4, 100, 4)
    far = spark.createDataFrame([("1", 101, 150)], "seqnames string, start long, end long")
    assert {r["node_id"] for r in A.frozen_nodes(nodes, far, margin=60).collect()} == {4}
    ring = walk_steps(spark, [[1, 2, 3, 4], [2, 3]], [False, True]).withColumn("gid", F.lit(0).cast("long"))
    ext = G.walk_external(ring, ["gid"])
    cn = G.walk_nodes(ring, ["gid"])
    scores = A.score_rings(ring.filter("circular").drop("kar_id"), cn, ext, nodes, amp)
    row = scores.first()
    assert row["max_cn"] == 1 and math.isclose(row["ampfrac"], 0.5)
    out = A.peel(scores, ring.filter("circular").select("gid", "walk_id", "circular", "pos", "n", "node"), cn, ext)
    total = {r["node_id"]: r["c"] for r in out.groupBy(F.abs("node").alias("node_id")).agg(F.sum("cn").alias("c")).collect()}
    assert total == {r["node_id"]: r["cn"] for r in cn.collect()}


def test_bestfit_finds_the_truth(spark):
    nodes = segments(spark, 9, 1_000_000, 3)
    steps = walk_steps(spark, THREE_WAY).withColumn("gid", F.lit(0).cast("long"))
    cn, edges = G.walk_nodes(steps, ["gid"]), G.walk_edges(steps, ["gid"])
    genome = nodes.drop("cn").join(cn.drop("gid"), "node_id")
    tiles = I.half_nodes(genome)
    truth = K.simulate(steps, genome, tiles, depth=50)
    fits = PL.bestfit_search(cn, edges, genome, truth, tiles, 200, depth=50, k=8, seed=4).collect()
    assert len(fits) == 8
    base = steps.select("kar_id", "walk_id", "circular", "pos", "n", "node")
    sampled, kars = PL.sample_karyotypes(cn, edges, 200, seed=4)
    pairs = kars.select(F.col("kar_id").alias("pair_id"), F.col("kar_id").alias("kar_a"), F.lit(-1).cast("long").alias("kar_b"))
    both = sampled.select("kar_id", F.col("walk_id").cast("long").alias("walk_id"), "circular", "pos", "n", "node").unionByName(
        base.withColumn("kar_id", F.lit(-1).cast("long")))
    edit = {r["pair_id"]: r["edit"] for r in D.edit_distance(pairs, both, nodes).collect()}
    best = min(fits, key=lambda r: r["nll"])
    assert edit[best["kar_id"]] == 0
    assert sorted(edit.values())[1] <= 6_000_000


def test_pair_distances(spark):
    nodes = segments(spark, 9, W, 3)
    a, b = walk_steps(spark, THREE_WAY, kar_id=1), walk_steps(spark, [*THREE_WAY[:5], [7, 8, -3, -2]], kar_id=2)
    c = walk_steps(spark, [[-v for v in reversed(w)] for w in THREE_WAY], kar_id=3)
    steps = a.unionByName(b).unionByName(c)
    pairs = D.all_pairs(steps.select("kar_id").distinct())
    got = {(r["kar_a"], r["kar_b"]): r for r in PL.pair_distances(
        steps, nodes, pairs, pix=50_000, read_length=150_000, edit_threshold=0).collect()}
    assert len(got) == 3
    same, diff = got[(1, 3)], got[(1, 2)]
    assert abs(same["hic"]) < 1e-9 and same["edit"] == 0 and abs(same["longread"]) < 1e-9
    assert diff["hic"] > 0 and diff["edit"] > 0 and diff["longread"] > 0
    kl = PL.group_kl(steps, nodes, pairs).collect()
    assert len(kl) == 3
    short = R.minimal_read_length(pairs, steps, nodes).collect()
    by = {r["pair_id"]: r["k"] for r in short}
    assert by[same["pair_id"]] is None and by[diff["pair_id"]] == 3

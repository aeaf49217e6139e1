"""Samples walked as lists, a graph dealt once: the same as the keyed way, with fewer shuffles."""

import pyarrow as pa
import pytest

from walkweave.operators import canonical as C
from walkweave.operators import graph as G
from walkweave.operators import sampling as S
from walkweave.operators import traversal as TV
from walkweave.plans import graph_queries as GQ
from walkweave.session import cut


@pytest.fixture(scope="module")
def wired(spark, sf):
    w, _, largest = GQ._bounded_wiring(spark, sf)
    return cut(w), largest


def _same(a, b):
    cols = sorted(a.columns)
    return sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_bound_of_the_largest_graph(wired):
    w, largest = wired
    assert largest == TV.largest_graph(w)


@pytest.mark.parametrize("unique", [False, True])
@pytest.mark.parametrize("frozen", [(), (3, 4, 5, 60)])
def test_lists_are_the_keyed_samples(wired, unique, frozen):
    w, largest = wired
    few = w.filter("gid < 60")
    a = S.sample_walks(few, 6, 5, frozen, unique)
    b = S.sample_walks(few, 6, 5, frozen, unique, largest=largest)
    assert _same(a, b) and not b.isEmpty()
    keys = lambda x, y: sorted(map(tuple, S.unique_karyotypes(x, y).select("gid", "kar_id", "members", "len", "circ", "h1", "h2").collect()))
    assert keys(a, None) == keys(S.sample_walks(few, 6, 5, frozen, unique, largest=largest, lists=True), largest)


def test_a_graph_is_dealt_once(wired):
    w, largest = wired
    plan = S.sample_walks(w, 4, 5, unique=True, largest=largest)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_frozen_nodes_as_a_table(spark, wired):
    w, largest = wired
    few, table = w.filter("gid < 20"), spark.createDataFrame([(3,), (4,), (3,)], "node_id int")
    assert _same(S.sample_walks(few, 3, 5, table, False, largest=largest), S.sample_walks(few, 3, 5, (3, 4), False))


def test_keys_of_long_lists(spark):
    ring = list(range(1, 301))
    rows = [(1, 1, True, ring), (1, 2, True, [-v for v in reversed(ring[40:] + ring[:40])]), (1, 3, False, ring), (1, 4, False, [1, 2]), (1, 5, False, [-2, -1])]
    walks = spark.createDataFrame(rows, "kar_id long, walk_id int, circular boolean, nodes array<int>")
    a = {r.walk_id: r[2:] for r in C.list_keys(walks).collect()}
    assert a == {r.walk_id: r[2:] for r in C.walk_keys(TV.list_steps(walks)).collect()}
    assert a[1] == a[2] != a[3] and a[4] == a[5]


def test_graphs_stay_whole_over_batches():
    gid = [1, 1, 2, 3, 3, 3, 3, 4]
    for size in (1, 2, 3, 8):
        table = pa.table({"gid": pa.array(gid, pa.int64()), "v": pa.array(range(8))})
        seen = [(t.column("gid").to_pylist(), t.column("v").to_pylist()) for t in TV.whole_graphs(iter(table.to_batches(max_chunksize=size)))]
        assert sum((v for _, v in seen), []) == list(range(8))
        assert sum(len(set(g)) for g, _ in seen) == 4


def test_whole_queries_take_the_short_way(spark, sf):
    assert G.largest_wiring(GQ._external(spark, sf)[0], ["kar_id"]) <= TV.LOCAL_ROWS


def test_known_sizes_spare_the_checkpoint(monkeypatch, wired):
    w, largest = wired
    rows = TV.traverse(w).count()
    monkeypatch.setattr(TV, "cut", lambda df: pytest.fail("rows of graphs that fit a task are written"))
    assert TV.traverse(w, largest=largest).count() == rows

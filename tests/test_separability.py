"""Separability by read sets and noisy maps: whole numbers of draws, and array forms against rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from walkweave.functions.rand import draw, numpy_draw, numpy_uniform, numpy_xxhash64, uniform
from walkweave.operators import contact as K
from walkweave.operators import distance as D
from walkweave.operators import neighbors as N
from walkweave.operators import reads as R
from walkweave.plans import distance_queries as DQ
from walkweave.plans import inference_queries as IQ
from walkweave.plans import pipelines as PL
from walkweave.plans import tables as T
from walkweave.session import cut


@pytest.fixture(scope="module")
def both(spark):
    rng = np.random.default_rng(4)
    rows = [(p, f"{k}|{p}", int(rng.integers(0, 40)), int(rng.integers(0, 40))) for p in (3, 8, -5) for k in range(30 + p)]
    return spark.createDataFrame([r for r in rows if r[2] + r[3]], "pair_id long, word string, a long, b long")


def sets_of(df):
    return {(r.pair_id, r.source, r.sample): r.llr for r in df.collect()}


def test_array_draws_are_the_row_draws(spark, both):
    keys = [(1, 2, 3), (-7, 0, 10**12), (2**40, 5, 1)]
    drawn = spark.createDataFrame(keys, "a long, b long, c long").select("a", "b", "c", uniform(9, *map(F.col, "abc")).alias("u")).collect()
    assert all(r.u == numpy_uniform(9, r.a, r.b, r.c) for r in drawn)
    few = sets_of(R.sampled_read_ratios(both, 300, 4, seed=3))
    many = sets_of(R.sampled_read_ratios(both, 300, 4, seed=3, wide=0))
    mixed = sets_of(R.sampled_read_ratios(both, 300, 4, seed=3, wide=30))
    assert set(few) == set(many) == set(mixed) and len(few) == 3 * 2 * 4
    assert all(abs(few[k] - many[k]) < 1e-6 and abs(few[k] - mixed[k]) < 1e-6 for k in few)


def test_counted_reads_have_the_law_of_drawn_ones(both):
    drawn, counted = (sets_of(f(both, 500, 400, seed=6, background=1.0)) for f in (R.sampled_read_ratios, R.counted_read_ratios))
    assert set(drawn) == set(counted)
    for pair in (3, 8, -5):
        for source in (0, 1):
            x, y = (np.array([v for k, v in d.items() if k[:2] == (pair, source)]) for d in (drawn, counted))
            assert abs(x.mean() - y.mean()) < 5 * x.std() / 14 and 0.8 < y.std() / x.std() < 1.25


def test_read_separability_draws_twenty_sets(spark, sf):
    assert DQ.DRAW_SETS == 20
    rates = [r.error_rate * 40 for r in DQ.read_separability(spark, sf).collect()]
    assert rates and all(abs(x - round(x)) < 1e-9 for x in rates)
    assert any(round(x) % 10 for x in rates)


def test_noisy_maps_against_numpy(spark):
    tiles = spark.createDataFrame([(k, 10_000, 2) for k in range(1, 151)], "tile_id int, width long, cn long")
    rng = np.random.default_rng(2)
    cells = [(i, j) for i in (1, 40, 70, 150) for j in (70, 150) if i <= j]
    values = {(kar, i, j): float(rng.uniform(1, 3)) for kar in (0, 1) for i, j in cells}
    pixels = spark.createDataFrame([(*k, v) for k, v in values.items()], "kar_id long, i int, j int, value double")
    pairs = spark.createDataFrame([(5, 0, 1), (6, 1, 1), (7, 8, 9)], "pair_id long, kar_a long, kar_b long")
    means = D.pair_means(pairs.filter("pair_id = 5"), pixels, tiles, 2, D.SYNTHETIC, "kar_id").collect()
    a, b = (np.array([r[c] for r in means]) for c in "ab")
    wrong = 0
    for source, m in enumerate((a, b)):
        x = rng.negative_binomial(2, 2 / (2 + m), (4000, len(m)))
        lp = lambda v: 2 * np.log(2 / (2 + v)) + x * np.log(v / (2 + v))  # noqa: B023, E731
        llr = (lp(a) - lp(b)).sum(1)
        wrong += ((llr < 0) if source == 0 else (llr > 0)).mean() / 2
    got = {r.pair_id: r.error_rate for r in D.contact_separability(pairs, pixels, tiles, 2, 4000, seed=8).collect()}
    assert got[6] == got[7] == 0.5  # equal maps, and two without contacts
    assert len(got) == 3 and 0.02 < wrong < 0.5 and abs(got[5] - wrong) < 0.03


def test_neighbors_of_several_starts(spark, sf, monkeypatch):
    asked = {}

    def record(wiring, genome, starts, chains, resolutions, depth=10, samples=20, cutoff=0.9, seed=1):
        asked.update(starts=starts, chains=chains, depth=depth, samples=samples)
        return spark.createDataFrame([("x", 1, 0.5)], "assay string, pairs long, separable double")

    monkeypatch.setattr(IQ, "neighbor_separable", record)
    IQ.neighbor_separability(spark, sf)
    assert asked["depth"] == 10 and asked["samples"] == 20 and asked["starts"] > 1 and asked["chains"] > 1
    wiring, _ = IQ._gid_wiring(spark, sf)
    steps, pairs = PL.neighbor_pairs(wiring.filter("gid < 40"), 3, 2, seed=4)
    rows = pairs.collect()
    assert rows and all(r.kar_a % 3 == 0 and r.kar_a < r.kar_b < r.kar_a + 3 for r in rows)
    per_graph = {}
    for r in rows:
        per_graph.setdefault(r.kar_a // 9, set()).add(r.kar_a)
    assert max(map(len, per_graph.values())) == 3
    assert {r.kar_id for r in steps.select("kar_id").distinct().collect()} >= {k for r in rows for k in (r.kar_a, r.kar_b)}


def test_numpy_draws_and_hashes_are_sparks(spark):
    rows = spark.range(50).select(F.col("id").alias("a"), (F.col("id") * -7 + 3).alias("b"))
    got = rows.select("a", "b", F.xxhash64("a", "b").alias("h"), draw(5, F.lit(0), F.col("a"), F.lit(2)).alias("d")).toPandas()
    assert (numpy_xxhash64(got.a.to_numpy(), got.b.to_numpy()) == got.h).all()
    assert (numpy_draw(5, 0, got.a.to_numpy(), 2) == got.d).all()


def test_neighbors_made_inside_tasks_are_those_of_rows(spark, sf):
    wiring, genome = cut(IQ._gid_wiring(spark, sf)[0].filter("gid < 60")), T.genome(spark, sf)
    tiles = PL.tiling(genome, 30_000)
    clipped = PL.tiling(genome, 30_000, genome.filter("seqnames IN ('chr1', 'chr4')").select("seqnames", "start", "end"))
    assays = [(genome.select("node_id", F.col("width").alias("nw")), PL._read_rates(genome, 60_000, 60, 20, 9), 45, 0.02)]
    assays += [(K.node_tiles(genome, t, ("cn",))[0], PL._map_rates(genome, t, 2, 20, 9), k, 0) for t, k in ((tiles, 45), (clipped, 0))]
    asked = []
    for table, (each, rows), items, ties in assays:
        def keyed(w, rows=rows):
            steps, pairs = PL.neighbor_pairs(w, 2, 2, 9)
            asked.append(w.select("gid").distinct().count())
            return rows(steps, pairs)

        few, other = ({r.pair_id: r.error_rate for r in N.by_graph(wiring, table, 2, 2, 9, each, keyed, k).collect()} for k in (512, items))
        assert set(few) == set(other) and len(few) > 50 and len(set(few.values())) > 3
        # a ratio of 0 up to rounding may fall to either side
        assert sum(abs(few[k] - other[k]) > 1e-9 for k in few) <= ties * len(few)
    graphs = wiring.select("gid").distinct().count()
    assert len(asked) == 3 and asked[2] == graphs and 0 < asked[0] < graphs

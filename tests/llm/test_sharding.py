"""Exact shard sizes, gapless slots, and the law of the communication matrix."""

from collections import Counter
from math import comb

from pyspark.sql import functions as F

from walkweave.llm.sharding import communication_matrix, hypergeometric, hypergeometric_shards, uniform


def test_rows_slots_and_copies(spark, odd):
    df = odd.union(odd).union(odd.where("doc_id = 4").crossJoin(spark.range(60)).drop("id")).repartition(5)
    rows = hypergeometric_shards(df, 7).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == df.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert Counter((r.doc_id, r.text, r.row) for r in rows) == Counter((r.doc_id, r.text, r.row) for r in df.collect())


def test_empty_and_fewer_rows_than_shards(spark, none, odd):
    assert hypergeometric_shards(none, 4).collect() == []
    rows = hypergeometric_shards(odd.limit(3), 16).collect()
    assert len({r.shard for r in rows}) == 3 and {r.slot for r in rows} == {0}


def test_order_is_shuffled(spark):
    rows = hypergeometric_shards(spark.range(4000), 4).collect()
    for s in range(4):
        ids = [r.id for r in sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)]
        rises = sum(a < b for a, b in zip(ids, ids[1:]))
        assert 440 < rises < 560
        assert abs(sum(ids) / len(ids) - 2000) < 200


def test_matrix_margins(spark):
    counts = spark.createDataFrame([(0, 40), (2, 1), (3, 500), (7, 59)], "source long, n long")
    rows = communication_matrix(counts, 6, 5).collect()
    assert {r.source: sum(r.to_shard) for r in rows} == {0: 40, 2: 1, 3: 500, 7: 59}
    assert [sum(r.to_shard[k] for r in rows) for k in range(6)] == [100] * 6


def test_hypergeometric_law(spark):
    good, bad, drawn, n = 5, 9, 6, 6000
    got = (spark.range(n).select(hypergeometric(F.lit(good).cast("long"), F.lit(bad).cast("long"), F.lit(drawn).cast("long"), uniform(F.lit(3), "id")).alias("k"))
           .groupBy("k").count().collect())
    for r in got:
        p = comb(good, r["k"]) * comb(bad, drawn - r["k"]) / comb(good + bad, drawn)
        assert abs(r["count"] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3
    large = spark.range(300).select(hypergeometric(F.lit(10**9), F.lit(15 * 10**9), F.lit(10**6), uniform(F.lit(4), "id")).alias("k"))
    mean, sd = large.agg(F.avg("k"), F.stddev("k")).first()
    assert abs(mean - 62500) < 60 and 180 < sd < 300

"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix, in DataFrame operations only."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkweave.session import cut

#: A matrix of this many source partitions at most is broadcast (16 longs each); a larger one is joined.
BROADCAST_SOURCES = 20_000
#: Rows of a shard that are ordered in one task, about.
SLOT_ROWS = 100_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, brought back down."""
    x = n + F.lit(8.0)
    down = F.lit(0.0)
    for k in range(1, 9):
        down = down + F.log(n + F.lit(float(k)))
    series = (x + 0.5) * F.log(x) - x + F.lit(0.5 * log(2 * pi)) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return series - down


def hypergeometric(good: Column, bad: Column, drawn: Column, u: Column) -> Column:
    """The number of good ones among ``drawn`` of ``good + bad``, by inversion at ``u``.

    The distribution is added up from 12 deviations and 30 counts below the mean; what lies farther out is below 1e-30.
    """
    good, bad, drawn = (c.cast("long") for c in (good, bad, drawn))
    total = (good + bad).cast("double")
    mean = F.when(total > 0, drawn.cast("double") * good / total).otherwise(F.lit(0.0))
    var = F.when(total > 1, mean * (bad / total) * (total - drawn) / (total - 1)).otherwise(F.lit(0.0))
    reach = (12 * F.sqrt(F.greatest(var, F.lit(0.0))) + 30).cast("long")
    least = F.greatest(F.lit(0).cast("long"), drawn - bad)
    low = F.greatest(least, mean.cast("long") - reach)
    high = F.least(F.least(drawn, good), mean.cast("long") + reach)

    def search(b: Column) -> Column:
        lo, hi = b["lo"], b["hi"]
        d = lambda c: c.cast("double")
        p = F.exp(log_factorial(d(good)) - log_factorial(d(lo)) - log_factorial(d(good - lo))
                  + log_factorial(d(bad)) - log_factorial(d(drawn - lo)) - log_factorial(d(bad - drawn + lo))
                  - log_factorial(total) + log_factorial(d(drawn)) + log_factorial(d(good + bad - drawn)))
        start = F.struct(p.alias("p"), p.alias("sum"), lo.alias("k"))

        def step(s: Column, k: Column) -> Column:
            # p(k) from p(k - 1); the count stays where the sum has passed u.
            q = s["p"] * d(good - k + 1) * d(drawn - k + 1) / (d(k) * d(bad - drawn + k))
            return let(q, lambda p2: F.struct(p2.alias("p"), (s["sum"] + p2).alias("sum"), F.when(s["sum"] < u, k).otherwise(s["k"]).alias("k")))

        return F.when(lo >= hi, lo).otherwise(F.aggregate(F.sequence(lo + 1, F.greatest(hi, lo + 1)), start, step)["k"])

    return let(F.struct(low.alias("lo"), high.alias("hi")), search)


def uniform(*keys: Column) -> Column:
    """A double in [0, 1) that depends on the keys only."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def draw_row(shards: Column, drawn: Column, seed: int, node: Column) -> Column:
    """How ``drawn`` rows out of those that fill ``shards`` fall on them: multivariate hypergeometric, one shard after the other."""

    def step(s: Column, i: Column) -> Column:
        left = s["left"]
        rest = s["rest"]
        good = F.element_at(shards, i)
        k = hypergeometric(good, rest - good, left, uniform(F.lit(seed), node, i))
        return let(k, lambda c: F.struct(F.concat(s["out"], F.array(c)).alias("out"), (left - c).alias("left"), (rest - good).alias("rest")))

    total = F.aggregate(shards, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(F.array().cast("array<bigint>").alias("out"), drawn.alias("left"), total.alias("rest"))
    return F.aggregate(F.sequence(F.lit(1), F.size(shards)), start, step)["out"]


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, to_shard): how many rows each source partition sends to each shard, for ``counts`` (source, n).

    The sources are halved again and again; each time the rows of the first half are drawn from what both send, so the
    matrix has exactly the law of a uniform permutation. A level is a projection; the sources of one half never meet
    those of the other, and the table has a row for each source at the end.
    """
    total, sources, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("source"), F.lit(0))).first()
    width = 1
    while width <= most:
        width *= 2
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    # Sums of rows below every node of the halving tree; node = (level width, index).
    level = counts.select(F.col("source").cast("long").alias("node"), F.col("n").cast("long").alias("n"))
    sums, w = [(1, level)], 1
    while w < width:
        level = level.groupBy(F.floor(F.col("node") / 2).alias("node")).agg(F.sum("n").alias("n"))
        w *= 2
        sums.append((w, level))
    spark = counts.sparkSession
    tree = spark.range(1).select(F.col("id").alias("node"), F.array(*[F.lit(x).cast("long") for x in sizes]).alias("to_shard"))
    for w, below in reversed(sums[:-1]):
        first = below.where("node % 2 = 0").select(F.floor(F.col("node") / 2).alias("node"), F.col("n").alias("first"))
        drawn = tree.join(first, "node", "left").select(
            "node", "to_shard", draw_row(F.col("to_shard"), F.coalesce("first", F.lit(0).cast("long")), seed + w, F.col("node")).alias("one"))
        tree = cut(drawn.select("node", F.posexplode(F.array(F.col("one"), F.zip_with("to_shard", "one", lambda a, b: a - b))).alias("side", "to_shard"))
                   .where(F.exists("to_shard", lambda x: x > 0))
                   .select((F.col("node") * 2 + F.col("side")).alias("node"), "to_shard"))
    return tree.select(F.col("node").cast("int").alias("source"), "to_shard")


def hypergeometric_shards(df: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """All rows and columns of ``df`` with shard and slot (0, 1, ... within a shard), a uniform permutation of the table.

    Shard sizes differ by one row at most. Each source partition is put into random order where it lies and cut up as the
    matrix says; rows then travel once, and are put into random order again within their shard. Rows, not keys, are dealt
    out: copies, repeated or null ids and hot sources fall evenly. ``df`` is written once, so that its partitions stay
    the same in every job that follows, whichever executors are lost. An empty table gives an empty result. Columns
    named shard or slot are replaced.
    """
    own = [c for c in df.columns if c not in ("shard", "slot")]
    base = cut(df.select(F.struct(*own).alias("row"))).select(
        "row", F.spark_partition_id().alias("source"), F.monotonically_increasing_id().alias("at"))
    counts = cut(base.groupBy("source").agg(F.count("*").alias("n")))
    matrix = communication_matrix(counts, shards, seed)
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("to_shard", 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    bounds = matrix.select("source", upto.alias("upto"))
    if counts.count() <= BROADCAST_SOURCES:
        bounds = F.broadcast(bounds)
    local = (base.withColumn("first", F.xxhash64(F.lit(seed), "at")).sortWithinPartitions("first", "at")
             .withColumn("rank", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    dealt = local.join(bounds, "source").select(
        "row", F.size(F.filter("upto", lambda x: x <= F.col("rank"))).alias("shard"), F.xxhash64(F.lit(seed + 1), "at").alias("order"), "at")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # A shard is ordered in slices of its random key, so that no task has a whole shard.
    slices = max(16, -(-total // (shards * SLOT_ROWS)))
    dealt = dealt.withColumn("slice", F.floor((F.shiftrightunsigned("order", 1).cast("double") / F.lit(float(1 << 63))) * slices).cast("long"))
    per = dealt.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.coalesce(
        F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = dealt.withColumn("rn", F.row_number().over(Window.partitionBy("shard", "slice").orderBy("order", "at")))
    return ranked.join(before, ["shard", "slice"]).select("row.*", "shard", (F.col("before") + F.col("rn") - 1).alias("slot"))

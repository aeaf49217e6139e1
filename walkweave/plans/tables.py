"""Domain inputs derived from the given tables (genome, walks, karyotypes, observed contacts).

A fixed genome of 120 segments on 12 chromosomes; every order is a walk through it.  The genome
does not grow with the data, the number of walks, karyotypes and observed contacts does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkweave.operators.skew import heavy_keys, key_profile, number_rows

SEGMENTS = 120
PER_CHROMOSOME = 10

STEP_ORDER = (
    "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
    "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)


@dataclass(frozen=True)
class Walks:
    """Walk steps ``(kar_id, walk_id, circular, pos, n, node)``.

    ``split`` tells that some walk is hot, ``hot_kar`` that some walk or karyotype is, ``longest``
    bounds the steps of a walk from above.
    """

    df: DataFrame
    split: bool
    longest: int
    hot_kar: bool


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node_id, seqnames, start, end, width, cn)``: SEGMENTS rows at most at every scale, so joins may broadcast it."""
    part = read(spark, sf_dir, "part")
    seg = part.groupBy((F.col("p_partkey") % SEGMENTS + 1).cast("int").alias("node_id")).agg(
        (20000 + 500 * (F.sum("p_size") % 61)).cast("long").alias("width"),
        (F.max("p_size") % 4 + 1).cast("int").alias("cn"),
    )
    chrom = F.floor((F.col("node_id") - 1) / PER_CHROMOSOME) + 1
    w = Window.partitionBy("seqnames").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    return F.broadcast(
        seg.withColumn("seqnames", F.concat(F.lit("chr"), chrom.cast("string")))
        .withColumn("end", F.sum("width").over(w))
        .withColumn("start", F.col("end") - F.col("width") + 1)
        .select("node_id", "seqnames", "start", "end", "width", "cn")
    )


def _steps(spark: SparkSession, sf_dir: str, per_flag: bool) -> Walks:
    lineitem = read(spark, sf_dir, "lineitem")
    node = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1) * (F.col("l_partkey") % SEGMENTS + 1)
    if per_flag:
        flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
        lineitem = lineitem.withColumn("walk_id", F.col("l_orderkey") * 3 + flag)
        kar, circular = F.col("l_orderkey"), F.col("l_returnflag") == "R"
    else:
        orders = read(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("walk_id"), "o_custkey", "o_orderstatus"
        )
        lineitem = lineitem.withColumn("walk_id", F.col("l_orderkey"))
    hot, longest = key_profile(lineitem.select("walk_id"), "walk_id")
    base = lineitem.withColumn("node", node.cast("int"))
    hot_kar = bool(hot)
    if not per_flag:
        hot_kar = hot_kar or bool(heavy_keys(orders.select("o_custkey"), "o_custkey"))
        base = base.join(orders, "walk_id")
        kar, circular = F.col("o_custkey"), F.col("o_orderstatus") == "P"
    numbered = number_rows(base, "walk_id", F.col("l_shipdate"), [F.col(c) for c in STEP_ORDER], hot)
    return Walks(
        numbered.select(kar.alias("kar_id"), "walk_id", circular.alias("circular"), "pos", "n", "node"),
        bool(hot),
        longest,
        hot_kar,
    )


def customer_walks(spark: SparkSession, sf_dir: str) -> Walks:
    """Karyotype = customer, walk = order, step = line in shipping order."""
    return _steps(spark, sf_dir, per_flag=False)


def order_walks(spark: SparkSession, sf_dir: str) -> Walks:
    """Karyotype = order, walk = lines of one return flag (at most three walks, ``R`` circular)."""
    return _steps(spark, sf_dir, per_flag=True)


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs ``(pair_id, kar_a, kar_b)``: each order with the next order number of its customer.

    Linear in the orders.  A customer may hold many orders; the hot ones are numbered in buckets.
    """
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    hot = heavy_keys(orders.select("o_custkey"), "o_custkey")
    ranked = number_rows(
        orders, "o_custkey", F.col("o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], hot
    )
    a = ranked.select("o_custkey", F.col("o_orderkey").alias("kar_a"), (F.col("pos") + 1).alias("pos"))
    b = ranked.select("o_custkey", F.col("o_orderkey").alias("kar_b"), "pos")
    return a.join(b, ["o_custkey", "pos"]).select(F.col("kar_a").alias("pair_id"), "kar_a", "kar_b")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed contacts between segments, ``(i, j, value)`` with ``i <= j`` and integer counts."""
    li = read(spark, sf_dir, "lineitem")
    a = (F.col("l_partkey") % SEGMENTS + 1).cast("int")
    b = (F.col("l_suppkey") % SEGMENTS + 1).cast("int")
    return li.groupBy(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).agg(
        F.sum("l_quantity").alias("value")
    )

"""Row numbering and running totals that survive hot keys.

A plain window puts one key into one task.  Keys that hold a large share of the rows are found
with one counting pass and numbered in two phases over an order-preserving bucket; all
other keys use the ordinary window, so the common case costs one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: a key with fewer rows than this is always left to one task
MIN_HOT_ROWS = 1_000_000
#: a key above this share of all rows is split
HOT_SHARE = 1 / 1000
#: buckets of the first counting pass (each at most a few rows of driver memory)
HASH_BUCKETS = 8192
#: rows of a side table up to which it is sent to every task
SMALL_ROWS = 200_000
#: walk positions are cut into blocks of this many rows once they are numbered
BLOCK = 1 << 16


def hinted(table: DataFrame, *sources: DataFrame) -> DataFrame:
    """``table`` with a broadcast hint if the rows of its sources, counted together, are at most ``SMALL_ROWS``.

    For tables with a row (or an array element) for each row of a source.
    """
    rows = None
    for source in sources:
        one = source.select(F.lit(1).alias("_"))
        rows = one if rows is None else rows.unionByName(one)
    return F.broadcast(table) if rows.count() <= SMALL_ROWS else table


def key_profile(df: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS) -> tuple[list, int]:
    """Keys holding more than ``max(min_rows, HOT_SHARE * rows)`` rows, and an upper bound on rows per key.

    Rows are first counted per hash bucket: map-side combining leaves at most ``HASH_BUCKETS`` counts
    to shuffle.  A bucket below the threshold cannot hide a hot key, so keys are counted only inside
    the buckets above it (usually none).  At most ``1 / HOT_SHARE`` keys can qualify.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(HASH_BUCKETS))
    sizes = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()
    bound = max((r["c"] for r in sizes), default=0)
    floor = max(min_rows, HOT_SHARE * sum(r["c"] for r in sizes))
    full = [r["b"] for r in sizes if r["c"] > floor]
    if not full:
        return [], bound
    counts = df.filter(bucket.isin(full) & F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return [r[0] for r in counts.filter(F.col("c") > floor).collect()], bound


def heavy_keys(df: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS) -> list:
    """Only the hot keys of :func:`key_profile`."""
    return key_profile(df, key, min_rows)[0]


def number_rows(
    df: DataFrame,
    key: str,
    bucket: Column,
    order: Sequence[Column],
    hot: Sequence | None = (),
    pos: str = "pos",
    total: str = "n",
) -> DataFrame:
    """Add the 1-based position of a row inside ``key`` and the number of rows of the key.

    ``bucket`` must be monotone in ``order`` (a prefix of it); it only matters for ``hot`` keys.
    ``hot=None`` splits every key.
    """
    w = Window.partitionBy(key)
    if hot is None:
        return _number_split(df, key, bucket, order, pos, total)
    is_hot = F.coalesce(F.col(key).isin(list(hot)), F.lit(False)) if hot else F.lit(False)
    cold = (df.filter(~is_hot) if hot else df).select(
        "*",
        F.row_number().over(w.orderBy(*order)).cast("long").alias(pos),
        F.count(F.lit(1)).over(w).alias(total),
    )
    if not hot:
        return cold
    return cold.unionByName(_number_split(df.filter(is_hot), key, bucket, order, pos, total))


def _number_split(df, key, bucket, order, pos, total) -> DataFrame:
    w = Window.partitionBy(key)
    spread = df.withColumn("_bucket", bucket)
    sizes = spread.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        key,
        "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(w).alias(total),
    )
    local = Window.partitionBy(key, "_bucket").orderBy(*order)
    return (
        spread.withColumn("_rank", F.row_number().over(local))
        .join(sizes, [key, "_bucket"])
        .select(*df.columns, (F.col("_before") + F.col("_rank")).alias(pos), total)
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    out: str,
    pos: str = "pos",
    split: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Inclusive running sum of ``value`` by ``pos`` inside ``keys``.

    With ``split`` the positions are cut into blocks: sums inside a block, plus the total of the
    blocks before it, so one long sequence is shared by many tasks.
    """
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not split:
        w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(*upto)
        return df.withColumn(out, F.sum(value).over(w))
    cut = df.withColumn("_blk", F.floor((F.col(pos) - 1) / block))
    totals = cut.groupBy(*keys, "_blk").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_blk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(*upto)
    return (
        cut.withColumn(out, F.sum(value).over(w))
        .join(totals, [*keys, "_blk"])
        .withColumn(out, F.col(out) + F.col("_off"))
        .drop("_blk", "_off")
    )

"""Closed 1-based intervals ``(seqnames, start, end)``: tiling, overlaps, reduction, re-binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkweave.operators.graph import _before


def footprint(ranges: DataFrame, by: Sequence[str] = ("seqnames",), bin_width: int = 1 << 20) -> DataFrame:
    """Union of ranges as maximal disjoint ranges (adjacent ones merge).

    Ranges are cut at bin borders and merged inside each bin.  Only pieces touching a border, at most
    two per bin, can go on in a neighbouring bin; these alone are merged once more.
    """
    cutup = explode_bins(ranges.select(*by, "start", "end"), bin_width).select(
        *by, "_bin",
        F.greatest("start", F.col("_bin") * bin_width).alias("start"),
        F.least("end", (F.col("_bin") + 1) * bin_width - 1).alias("end"),
    )
    pieces = _merge(cutup, [*by, "_bin"]).drop("_bin")
    touches = (F.col("start") % bin_width == 0) | ((F.col("end") + 1) % bin_width == 0)
    return pieces.filter(~touches).unionByName(_merge(pieces.filter(touches), list(by)))


def _merge(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0)
    runs = ranges.withColumn("_new", opens).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def explode_bins(df: DataFrame, bin_width: int, start: str = "start", end: str = "end") -> DataFrame:
    lo, hi = F.floor(F.col(start) / bin_width), F.floor(F.col(end) / bin_width)
    return df.withColumn("_bin", F.explode(F.sequence(lo, hi)))


def overlap_join(a: DataFrame, b: DataFrame, bin_width: int, how: str = "pieces") -> DataFrame:
    """Overlapping pairs of two range tables as an equi-join on (seqnames, bin).

    A pair sharing several bins is kept only in the bin where its overlap starts, so nothing has to
    be de-duplicated.  ``pieces`` adds ``start``/``end`` of the intersection; ``pairs`` does not.
    Columns other than ``seqnames/start/end`` must differ between the two sides.
    """
    left = explode_bins(a.withColumnsRenamed({"start": "_as", "end": "_ae"}), bin_width, "_as", "_ae")
    right = explode_bins(b.withColumnsRenamed({"start": "_bs", "end": "_be"}), bin_width, "_bs", "_be")
    lo, hi = F.greatest("_as", "_bs"), F.least("_ae", "_be")
    hits = left.join(right, ["seqnames", "_bin"]).filter((lo <= hi) & (F.floor(lo / bin_width) == F.col("_bin")))
    if how == "pieces":
        hits = hits.withColumns({"start": lo, "end": hi})
    elif how != "pairs":
        raise ValueError(f"unknown result {how!r}")
    return hits.drop("_bin", "_as", "_ae", "_bs", "_be")


def overlap_semi(a: DataFrame, b: DataFrame, bin_width: int, key: str) -> DataFrame:
    """Rows of ``a`` that overlap any range of ``b``; ``key`` identifies a row of ``a``."""
    spans = footprint(b, bin_width=bin_width)
    hits = overlap_join(a.select(key, "seqnames", "start", "end"), spans, bin_width, "pairs").select(key)
    return a.join(hits, key, "left_semi")


def tile_nodes(nodes: DataFrame, pix: int, regions: DataFrame | None = None) -> DataFrame:
    """Fixed-width tiles of the regions cut at node borders: ``(tile_id, node_id, seqnames, start, end, width, cn)``.

    Tiling starts at each region's start.  Without regions the chromosomes' footprints are used.
    """
    if regions is None:
        regions = nodes.groupBy("seqnames").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = regions.select("seqnames", F.col("start").alias("_rs"), F.col("end").alias("_re"))
    both = nodes.join(spans, "seqnames").filter((F.col("start") <= F.col("_re")) & (F.col("_rs") <= F.col("end")))
    first = F.floor((F.greatest("start", "_rs") - F.col("_rs")) / pix)
    last = F.floor((F.least("end", "_re") - F.col("_rs")) / pix)
    both = both.withColumns({"_first": first, "_count": last - first + 1})
    both = _before(both, [], ["seqnames"], ["_rs", "node_id"], "_count", "_off", split=True)
    tiles = both.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)))
    lo = F.col("_rs") + (F.col("_first") + F.col("_k")) * pix
    return tiles.select(
        (F.col("_off") + F.col("_k") + 1).cast("int").alias("tile_id"),
        "node_id", "seqnames",
        F.greatest("start", "_rs", lo).alias("start"),
        F.least("end", "_re", lo + (pix - 1)).alias("end"),
        "cn",
    ).withColumn("width", F.col("end") - F.col("start") + 1)


def windows(regions: DataFrame, width: int) -> DataFrame:
    """Fixed-width windows of each region, the last one truncated: ``(tile_id, seqnames, start, end)``."""
    spans = regions.select("seqnames", F.col("start").alias("_rs"), F.col("end").alias("_re"))
    spans = spans.withColumn("_count", F.floor((F.col("_re") - F.col("_rs")) / width) + 1)
    spans = _before(spans, [], ["seqnames"], ["_rs"], "_count", "_off", split=True)
    cut = spans.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)))
    lo = F.col("_rs") + F.col("_k") * width
    return cut.select(
        (F.col("_off") + F.col("_k") + 1).cast("int").alias("tile_id"), "seqnames",
        lo.alias("start"), F.least(lo + (width - 1), F.col("_re")).alias("end"),
    )


def half_nodes(nodes: DataFrame) -> DataFrame:
    """Two tiles per node: the left half gets ``floor(width / 2)`` bases.  Tile ids follow the node ids, or the numbers of
    the pieces where nodes were cut (``piece``)."""
    at = "piece" if "piece" in nodes.columns else "node_id"
    width = F.col("end") - F.col("start") + 1
    left = F.floor(width / 2)
    return nodes.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right")))).select(
        (F.col(at) * 2 - F.when(F.col("side") == "left", 1).otherwise(0)).cast("int").alias("tile_id"),
        "node_id", "seqnames", "side",
        F.when(F.col("side") == "left", F.col("start")).otherwise(F.col("start") + left).alias("start"),
        F.when(F.col("side") == "left", F.col("start") + left - 1).otherwise(F.col("end")).alias("end"),
        "cn",
    ).withColumn("width", F.col("end") - F.col("start") + 1)


def rebin(pixels: DataFrame, source: DataFrame, target: DataFrame, bin_width: int, by: Sequence[str] = ()) -> DataFrame:
    """Move ``(i, j, value)`` from ``source`` tiles to ``target`` tiles by overlapped area.

    The overlap table holds one row per overlapping tile pair; every pixel is spread along each axis
    by an equi-join and summed again.
    """
    pieces = overlap_join(
        source.select(F.col("tile_id").alias("src"), "seqnames", "start", "end",
                      (F.col("end") - F.col("start") + 1).alias("_w")),
        target.select(F.col("tile_id").alias("dst"), "seqnames", "start", "end"),
        bin_width,
    ).select("src", "dst", ((F.col("end") - F.col("start") + 1) / F.col("_w")).alias("frac"))
    on_i = pieces.select(F.col("src").alias("i"), F.col("dst").alias("p"), F.col("frac").alias("fi"))
    on_j = pieces.select(F.col("src").alias("j"), F.col("dst").alias("q"), F.col("frac").alias("fj"))
    return (
        pixels.select(*by, "i", "j", "value").join(on_i, "i").join(on_j, "j")
        .groupBy(*by, F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
        .agg(F.sum(F.col("value") * F.col("fi") * F.col("fj")).alias("value"))
    )


def coarse_grain(pixels: DataFrame, resolutions: Sequence[int], fine: int) -> DataFrame:
    """One matrix at several resolutions (tile ``i`` of the fine matrix starts at ``(i - 1) * fine``)."""
    res = F.explode(F.array(*[F.lit(int(r)) for r in resolutions])).alias("resolution")
    at = lambda c: (F.floor((F.col(c) - 1) * fine / F.col("resolution")) + 1).cast("int")
    return pixels.select("*", res).groupBy("resolution", at("i").alias("i"), at("j").alias("j")).agg(
        F.sum("value").alias("value")
    )

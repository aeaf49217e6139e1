"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "i int, j int, value double"
TILES = "tile_id int, seqnames string, start long, end long"
NODES = "node_id int, seqnames string, start long, end long, cn int, loose_cn_left int, loose_cn_right int"
EDGES = "n1 int, n1_side string, n2 int, n2_side string, cn int, type string"
BANDS = "seqnames string, start long, end long, band string, stain string"

# Chromosomes kept from a cytoband file.
CHROMOSOMES = [*(str(k) for k in range(1, 23)), "X", "Y"]


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header (``.csv``) or parquet."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.schema(schema).csv(path, header=True)
    return spark.read.schema(schema).parquet(path)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, PIXELS)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, TILES).withColumn("width", F.col("end") - F.col("start") + 1)


def read_cytobands(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated bands, 0-based starts turned 1-based, main chromosomes only, ``chr`` dropped."""
    bands = spark.read.schema(BANDS).csv(path, sep="\t", comment="#")
    bands = bands.withColumns({"seqnames": F.regexp_replace("seqnames", "^chr", ""), "start": F.col("start") + 1})
    return bands.filter(F.col("seqnames").isin(CHROMOSOMES))


def read_graphs(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """``nodes`` or ``edges`` of all graphs in a folder: ``<graph>__<part>.parquet``, keyed by graph name."""
    if part not in ("nodes", "edges"):
        raise ValueError(f"unknown table {part!r}")
    schema = NODES if part == "nodes" else EDGES
    rows = spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/*__{part}.parquet")
    name = F.regexp_extract(F.input_file_name(), rf"([^/]+)__{part}\.parquet", 1)
    return rows.withColumn("graph_id", name)

"""Writers: one CSV folder per table, JSON, benchmark history, calibration tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkweave.sources.calibration import Decay

HISTORY = "graph string, N long, version string, phase string, seconds double, date timestamp, git_commit string, n_configs int"


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table as ``<folder>/<name>`` in CSV with a header."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{folder.rstrip('/')}/{name}", header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_history(results: DataFrame, path: str) -> None:
    """Add rows to the history; columns the history does not know yet are added, missing ones are NULL."""
    results.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def summarize_history(results: DataFrame) -> DataFrame:
    """One row per graph and N, one column per version and phase."""
    named = results.withColumn("_c", F.concat_ws("_", "version", "phase"))
    return named.groupBy("graph", "N").pivot("_c").agg(F.first("seconds"))


def decay_table(spark: SparkSession, decay: Decay) -> DataFrame:
    """The calibration as a coefficient table."""
    rows = [("distance", float(x), *map(float, c)) for x, c in zip(decay.starts, decay.coefs)]
    rows.append(("diagonal", 0.0, float(decay.diagonal[0]), float(decay.diagonal[1]), 0.0, 0.0))
    rows.append(("interchrom", 0.0, float(decay.interchrom), 0.0, 0.0, 0.0))
    rows.append(("min_resolution", 0.0, float(decay.min_resolution), 0.0, 0.0, 0.0))
    return spark.createDataFrame(rows, "model string, x double, c0 double, c1 double, c2 double, c3 double")


def load_decay(table: DataFrame) -> Decay:
    rows = table.orderBy("model", "x").collect()
    of = lambda m: [r for r in rows if r["model"] == m]
    pieces, diagonal = of("distance"), of("diagonal")[0]
    return Decay(
        tuple(r["x"] for r in pieces), tuple((r["c0"], r["c1"], r["c2"], r["c3"]) for r in pieces),
        (diagonal["c0"], diagonal["c1"]), of("interchrom")[0]["c0"], of("min_resolution")[0]["c0"])

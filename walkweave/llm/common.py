"""Shared helpers of the operators: tables, written intermediate results, batches of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from walkweave.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared checkpoint folder (``spark.checkpoint.dir``; a private one only in local mode)."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[len("file:"):]
    return f"{base}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "stored") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage is cut, lost executors lose nothing."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(batches, step: int = 512):
    """Arrow record batches in slices of at most ``step`` rows, so that long texts do not pile up as Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def texts_of(batch, name: str = "text") -> list[str]:
    """A string column as Python strings, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def row_key(partition: int, k: int) -> int:
    """A number for row ``k`` of a partition, unique over the table."""
    return (partition << 40) + k

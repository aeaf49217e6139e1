"""Registered queries on the smallest tables, sources and sinks."""

import importlib
import tempfile

import pytest
from pyspark.sql import functions as F

from oracle_check import compare, oracle
from walkweave.plans.registry import registered
from walkweave.sources import readers, sinks
from walkweave.sources.calibration import SYNTHETIC
from walkweave.sources.generators import RECIPROCAL

NAMES = list(registered())


@pytest.mark.parametrize("name", NAMES)
def test_registered_query(spark, sf, name):
    fn, sql = registered()[name]
    ok, rows, other, note = compare(spark, oracle(sf), sf, fn, sql)
    assert ok is not False, note
    assert rows > 0 or other == 0


def test_entry(spark, sf):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sources_and_sinks(spark):
    folder = tempfile.mkdtemp(prefix="walkweave-test-")
    px = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)], "i int, j int, value double")
    sinks.write_tables({"gm_dat": px}, folder)
    back = spark.read.schema(readers.PIXELS).csv(f"{folder}/gm_dat", header=True)
    assert back.exceptAll(px).count() == 0
    sinks.write_json(px, f"{folder}/px.json")
    assert spark.read.json(f"{folder}/px.json").count() == 2
    with open(f"{folder}/bands.txt", "w") as f:
        f.write("chr1\t0\t10\tp1\tgneg\nchrUn\t0\t5\tx\tgneg\nchrX\t10\t20\tq\tgpos\n")
    bands = {(r["seqnames"], r["start"], r["end"]) for r in readers.read_cytobands(spark, f"{folder}/bands.txt").collect()}
    assert bands == {("1", 1, 10), ("X", 11, 20)}
    table = sinks.decay_table(spark, SYNTHETIC)
    assert sinks.load_decay(table) == SYNTHETIC
    node = spark.createDataFrame([(1, "1", 1, 10, 2, None, None)], readers.NODES)
    node.write.parquet(f"{folder}/g1__nodes.parquet")
    assert readers.read_graphs(spark, folder, "nodes").first()["graph_id"] == "g1"


def test_history(spark):
    rows = [("cis1", n, v, "walk", float(n)) for n in (10, 20) for v in ("a", "b")]
    df = spark.createDataFrame(rows, "graph string, N long, version string, phase string, seconds double")
    folder = tempfile.mkdtemp(prefix="walkweave-test-")
    sinks.append_history(df, f"{folder}/h")
    sinks.append_history(df.withColumn("git_commit", F.lit("x")), f"{folder}/h")
    assert sinks.read_history(spark, f"{folder}/h").filter("git_commit IS NULL").count() == 4
    assert sinks.summarize_history(df).count() >= 1

"""Run registered queries against DuckDB: ``python tests/oracle_check.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_norm(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark, con, sf_dir, fn, sql):
    """(matches, spark rows, oracle rows, note)."""
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if not sql:
        return None, len(mine), None, "rows only"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, len(mine), len(theirs), f"columns {sorted(df.columns)} vs {sorted(names)}"
    if mine == theirs:
        return True, len(mine), len(theirs), ""
    diff = [(a, b) for a, b in zip(mine, theirs) if a != b][:3]
    return False, len(mine), len(theirs), f"{sorted(names)} first differences: {diff}"


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from walkweave.session import get_session

    sf_dir, wanted = argv[0], argv[1:]
    spark = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    con.execute("SET memory_limit = '8GB'")
    bad = 0
    for name, fn in queries().items():
        sql = oracle_sql().get(name)
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            ok, n, m, note = compare(spark, con, sf_dir, fn, sql)
        except Exception as exc:  # noqa: BLE001
            ok, n, m, note = False, None, None, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += ok is False
        print(f"{'ok ' if ok else '-- ' if ok is None else 'BAD'} {name:28s} {time.time() - t:6.1f}s rows={n}/{m} {note}", flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

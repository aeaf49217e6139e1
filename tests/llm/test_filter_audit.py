"""The audit of filters against a plain loop over documents and orders."""

import re
from itertools import permutations

from pyspark.sql import functions as F

from oracle_check import compare, oracle
from walkweave.llm.common import table
from walkweave.llm.filter_audit import filter_audit, walk_orders
from walkweave.llm.queries import ORACLES, QUERIES

WORD = r"[^\x20\x09-\x0D]+"


def failed(text):
    ws, out = re.findall(WORD, text), set()
    if len(ws) < 100:
        out.add("A")
    if 100 * len(set(ws)) < 80 * len(ws):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    return out


def brute(docs, labels):
    least, out = {}, {}
    for d in docs:
        if d.doc_id is not None:
            t = d.text or ""
            least[t] = min(least.get(t, d.doc_id), d.doc_id)
    good = {x.doc_id for x in labels if x.quality == 1 and x.doc_id is not None}
    toxic = {x.doc_id for x in labels if x.toxic == 1 and x.doc_id is not None}
    rows = [(d.lang or "", d.doc_id, failed(d.text or "") | ({"E"} if d.doc_id is not None and d.doc_id > least[d.text or ""] else set())) for d in docs]
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, letter in enumerate(order):
                gone = [r for r in left if letter in r[2]]
                redundant = sum(letter in r[2] for r in mine) - len(gone)
                left = [r for r in left if letter not in r[2]]
                shapley[letter] += len(gone)
                out[part, "".join(order), k + 1] = [letter, len(left), len(gone), redundant, sum(r[2] == {letter} for r in mine),
                                                    sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[out[key][0]])
    return out


def result(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): [r.letter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(got) == len(rows)
    return got


def test_whole_table(spark, sf):
    docs, labels = table(spark, sf, "documents").collect(), table(spark, sf, "labels").collect()
    got = result(QUERIES["op12_filter_audit"](spark, sf))
    assert got == brute(docs, labels) and len(got) == 600 * len({d.lang for d in docs})


def test_against_sql(spark, sf):
    ok, _, _, note = compare(spark, oracle(sf), sf, QUERIES["op12_filter_audit"], ORACLES["op12_filter_audit"])
    assert ok, note


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(150))
    rows = [(1, long, "en"), (2, long, "en"), (2, long, "de"), (2, long, "de"), (None, long, "en"), (None, None, None), (None, "", ""), (3, None, "en"), (4, "", "de"),
            (5, "a b " * 100, None), (6, "X" * 40 + " # x", "en"), (7, "  w " * 120, "en"), (8, long + " &", "en"), (9, "Ä" * 9 + "A", "en"), (9, "w " * 3_000_000, "en")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, lang string, mask int, quality int")
    labels = spark.createDataFrame([(1, 1, None, "x"), (2, 0, 1, "x"), (2, 1, 0, "x"), (None, 1, 1, "x"), (6, None, 1, "x"), (99, 1, 1, "x")],
                                   "doc_id long, quality int, toxic int, part string")
    got = result(filter_audit(docs, labels))
    assert got == brute(docs.collect(), labels.collect())
    assert {k[0] for k in got} == {"", "de", "en"}
    assert filter_audit(docs.where("false"), labels).collect() == []
    assert result(filter_audit(docs, labels.where("false")))["en", "ABCDE", 1][5:7] == [0, 0]


def test_own_filters_and_prefixes(spark):
    cells = spark.createDataFrame([(0,), (3,)], "mask int")
    walk = walk_orders(cells, ["P", "Q", "R"])
    assert walk.count() == 2 * (3 + 6 + 6)
    docs = spark.createDataFrame([(k, f"t{k % 3}", "x") for k in range(9)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = result(filter_audit(docs, labels, {"P": F.col("doc_id") > 6}, duplicate="Q"))
    assert got["x", "PQ", 1][:5] == ["P", 7, 2, 0, 0] and got["x", "PQ", 2][:5] == ["Q", 3, 4, 2, 4]

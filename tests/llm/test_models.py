"""Personal data against the base patterns and a planted truth; toxicity on held-out labels."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from walkweave.llm import personal, toxicity
from walkweave.llm.queries import QUERIES


def brute_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


PART = st.sampled_from(["a", "b.c", "@", "@x", ".", "-", " ", "+", "1", "255", "256", "007", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+12", "é", "me@mail.com", "10.0.0.1", "%", "\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PART, max_size=14).map("".join))
def test_base_spans(text):
    assert personal.base_spans(text) == brute_base(text)


def test_long_runs_end():
    assert personal.base_spans("a" * 20000 + "@" + "b" * 20000) == []
    assert personal.base_spans("1" * 20000 + "." + "0" * 20000) == []
    model = personal.estimate([("name", (0, 1, 0, 1, 0), 3)])
    for text in ("7" * 1_000_000, "7" * 300_000 + ".7" * 100_000, "1.2.3." * 100_000 + "x", "a.b" * 300_000 + " at dot", "+1" * 300_000, "@" * 300_000, "12-" * 300_000):
        start = time.time()
        personal.all_spans(text, model)
        assert time.time() - start < 5, text[:9]
    start = time.time()
    spans = personal.all_spans("Anna Berg 10.1.2.3 (501) 555-7713 " * 20_000, model)
    assert len(spans) >= 20_000 and time.time() - start < 15


TRUE = ["contact me at jo.doe@mail.com today", "server ip 83.229.25.121 is up", "pay with card 4111 1111 1111 1111 now", "call +1 (501) 555-7713 soon",
        'token = "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587"', "ssn 123-45-6789", "phone (501) 555-7713", "write to jo.doe (at) mail (dot) com"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    return spark.createDataFrame([(k, f"{rng.choice(['lorem', 'ipsum'])} {rng.choice(TRUE)} and more words") for k in range(300)], "doc_id long, text string")


def test_estimate_tells_good_labelers(corpus):
    model = personal.fit(corpus)
    assert all(0.5 < r < 1 for r in model.reliability)
    # A planted world: two labelers right nine times in ten, one that guesses.
    rng = np.random.default_rng(0)
    truth = rng.random(6000) < 0.4
    cast = [np.where(rng.random(6000) < p, truth, ~truth) for p in (0.92, 0.9, 0.5, 0.9, 0.85)]
    counts = {}
    for row in zip(*cast, strict=True):
        v = tuple(1 if x else -1 for x in row)
        counts[v] = counts.get(v, 0) + 1
    model = personal.estimate([("card", v, n) for v, n in counts.items()])
    assert model.reliability[2] < 0.6 and min(model.reliability[0], model.reliability[1], model.reliability[3]) > 0.85
    right = sum((model.score("card", tuple(1 if x else -1 for x in row)) > 0.5) == t for row, t in zip(zip(*cast, strict=True), truth, strict=True))
    assert right / 6000 > 0.95


def test_find_spans(spark, corpus, odd):
    model = personal.fit(corpus)
    df = odd.union(spark.createDataFrame([(70 + k, t, "s", k) for k, t in enumerate(TRUE)], odd.schema)).withColumnRenamed("row", "spans").withColumnRenamed("shard", "kind")
    rows = personal.find_spans(df, model).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == brute_base(r.text or "")
        assert all(0 <= s.score <= 1 for s in r.spans)
    kinds = {r.doc_id: {s.kind for s in r.spans} for r in rows if r.doc_id and r.doc_id >= 70}
    assert [next(iter(kinds[70 + k])) for k in range(len(TRUE))] == ["email", "ip", "card", "phone", "secret", "ssn", "phone", "email"]
    masked = {r.doc_id: r.text for r in personal.find_spans(df, model, redact=True).collect()}
    assert masked[70] == "contact me at [EMAIL] today" and masked[74] == 'token = "[SECRET]"' and masked[6] == "the same text"


def test_personal_empty(none):
    model = personal.fit(none)
    assert personal.find_spans(none, model).collect() == []
    assert [s[:3] for s in personal.all_spans("a@b.c", model)] == [("email", 0, 5)]


def test_overlapping_spans_are_masked_once():
    assert personal.redacted("ab 12 cd", [("card", 3, 5, 1.0, True), ("phone", 4, 7, 1.0, True)]) == "ab [CARD]d"


def test_personal_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op8_personal_data"](spark, sf).collect():
        base = brute_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in personal.BASE)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_cumulative_link_recovers_a_planted_model():
    rng = np.random.default_rng(1)
    true, theta = np.array([2.0, -1.5, 0.0]), np.array([0.5, 2.0])
    rows = [(np.flatnonzero(c), c[c > 0].astype(float)) for c in rng.integers(0, 3, (4000, 3))]
    z = np.array([v @ true[k] for k, v in rows])
    grades = (rng.logistic(size=4000) + z > theta[0]).astype(int)
    e = rng.logistic(size=4000) + z
    grades = (e > theta[0]).astype(int) + (e > theta[1])
    w, t = fit = toxicity.fit_cumulative_link(rows, grades, 3, 3, steps=400)
    assert np.abs(w - true).max() < 0.25 and np.abs(t - theta).max() < 0.25 and t[0] < t[1], fit


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    insults = ["scum", "moron", "trash", "clown"]
    docs, labels = [], []
    for k in range(700):
        toxic = k % 5 == 0
        w = [f"w{rng.randrange(80)}" for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.randrange(2, 12) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(insults)
        docs.append((k, " ".join(w), "x"))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, grade string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(labelled, odd):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.where("doc_id < 500"))
    rows = toxicity.severity(docs.where("doc_id >= 500"), model).collect()
    right = sum(r.toxic == (r.doc_id % 5 == 0) for r in rows)
    assert len(rows) == 200 and right >= 196
    assert list(model.thresholds) == sorted(model.thresholds)
    toxic = [r for r in rows if r.toxic]
    hits = np.array([sum(x in r.text for x in ("scum", "moron", "trash", "clown")) for r in toxic])
    assert np.corrcoef(hits, [r.severity for r in toxic])[0, 1] > 0.3
    scored = toxicity.severity(odd.withColumnRenamed("row", "severity"), model).collect()
    assert len(scored) == odd.count() and not any(r.toxic for r in scored)


def test_toxicity_edges(spark, labelled, none):
    docs, labels = labelled
    nothing = toxicity.fit(docs, labels.where("toxic = 0"))
    assert not any(r.toxic for r in toxicity.severity(docs.limit(30), nothing).collect())
    assert toxicity.fit(docs, labels.where("false")).weights == {}
    assert toxicity.severity(none, nothing).collect() == []
    messy = labels.union(labels.limit(50)).union(spark.createDataFrame([(None, 1), (3, None), (10**9, 1)], labels.schema))
    assert toxicity.fit(docs, messy).weights


def test_toxicity_of_given_tables(spark):
    """Three labelled texts in four are fitted or more; agreement over all labelled ones."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    said = {r.doc_id: r.toxic for r in toxicity.severity(docs, model).collect()}
    pairs = [(r.toxic, said[r.doc_id]) for r in labels.collect()]
    assert sum(bool(a) == b for a, b in pairs) / len(pairs) > 0.95

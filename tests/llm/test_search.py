"""Decontamination, license templates and top-k search against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from walkweave.llm.decontamination import WuManber, contamination
from walkweave.llm.licenses import TEMPLATES, Automaton, license_scan, scan
from walkweave.llm.queries import QUERIES
from walkweave.llm.top_k import threshold_search, top_k
from walkweave.llm.words import words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode()))


@given(st.text(max_size=60))
def test_words(text):
    assert words(text.encode("utf-8", "surrogatepass")) == WORD.findall(re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), text.encode("utf-8", "surrogatepass")))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4), st.data())
def test_wu_manber(length, data):
    letter = st.sampled_from([b"a", b"b", b"c"])
    patterns = data.draw(st.sets(st.tuples(*[letter] * length), min_size=1, max_size=5))
    text = data.draw(st.lists(letter, max_size=40))
    found = [(s, tuple(i)) for s, i in WuManber({p: [str(p)] for p in patterns}).search(text)]
    assert found == [(k, (str(tuple(text[k:k + length])),)) for k in range(len(text) - length + 1) if tuple(text[k:k + length]) in patterns]


def brute_contamination(text, items, size=13):
    w, hit, named = plain_words(text), set(), set()
    for item, t in items:
        p = plain_words(t)
        for a in range(max(1, len(p) - size + 1) if p else 0):
            q = p[a:a + size]
            for k in range(len(w) - len(q) + 1):
                if w[k:k + len(q)] == q:
                    hit.update(range(k, k + len(q)))
                    named.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("chunk", [50_000, 3])
def test_contamination(spark, odd, chunk):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(9)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(20)), (2, text(14)), (10, "The same TEXT"), (11, "the same text"), (None, text(13)), (3, None), (4, ""), (5, "a"), (2, text(5))]
    own = [(100 + k, f"{text(30)} {rng.choice([t for _, t in items if t])} {text(rng.choice([0, 400]))}", "s", k) for k in range(12)]
    docs = odd.union(spark.createDataFrame(own, odd.schema)).withColumnRenamed("shard", "items")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs, benchmark, chunk=chunk).collect()
    assert len(got) == docs.count() and sum(r.contaminated for r in got) > 8
    for r in got:
        assert (r.found.n_words, r.n_hit, r.found["items"], r.contaminated) == brute_contamination(r.text, items)


def test_contamination_empty(spark, odd, none):
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(none, benchmark).collect() == []
    assert not any(r.contaminated or r.n_hit for r in contamination(odd, benchmark.where("false")).collect())


def test_contamination_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {}
    for item, t in items:
        w = plain_words(t)
        for a in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[a:a + 13]), set()).add(str(item))
    for r in QUERIES["op5_decontamination"](spark, sf).collect():
        w, hit, named = plain_words(texts[r.doc_id]), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k:k + n]))):
                    hit.update(range(k, k + n))
                    named |= found
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(named))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()


def test_automaton_regions():
    a = Automaton("x", "one two [[maybe {{0-2}} so]] three {{1-2}} end")
    run = lambda t: a.run(t.encode().split())
    assert run("one two three x end rest")[0] == 5
    assert run("one two maybe so three x y end")[0] == 8
    assert run("one two maybe p q so three x end")[0] == 9
    assert run("one two maybe p q r so three x end") == (None, 2 / 4)
    assert run("one two three end")[0] is None
    assert run("one two extra three x end")[0] is None
    assert run("") == (None, 0.0)


def brute_licenses(text):
    w, starts, labels = plain_words(text), [], set()
    for phrase, label in ((b"under the mit license", "mit"), (b"apache license version 2", "apache-2"), (b"cc by nc", "cc-by-nc")):
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k:k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)


def test_license_scan(spark, odd):
    texts = ["Released under the MIT License. and UNDER the mit license, CC-BY-NC", "licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0",
             "This work is licensed under the GNU General Public License, version 3 or any later version", "apache license version 20", "the mit license",
             "licensed under the terms of the gnu general public license as published by someone else version 3"]
    docs = odd.union(spark.createDataFrame([(50 + k, t, "s", k) for k, t in enumerate(texts)], odd.schema)).withColumnRenamed("shard", "labels")
    got = license_scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        x = r.license
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute_licenses(r.text)
        assert set(x.base_labels) <= set(x.labels) and 0 <= x.score <= 1
    by = {r.doc_id: r.license for r in got if r.doc_id and r.doc_id >= 50}
    assert by[50].labels == ["cc-by-nc", "mit"] and by[51].labels == ["apache-2"] and by[51].score == 1
    assert by[53].labels == ["gpl-3"] and by[53].matches[0].end - by[53].matches[0].start == 13
    assert by[54].labels == [] and by[55].labels == [] and by[56].labels == [] and 0 < by[56].score < 1


def expansion(markup):
    """A template as a regular expression over words that each end in a space."""
    out, pattern = re.split(r"(\[\[|\]\]|\{\{\d+-\d+\}\})", markup), ""
    for token in out:
        if token == "[[":
            pattern += "(?:"
        elif token == "]]":
            pattern += ")?"
        elif token.startswith("{{"):
            low, high = token[2:-2].split("-")
            pattern += f"(?:[^ ]+ ){{{low},{high}}}"
        else:
            pattern += "".join(re.escape(w) + " " for w in token.split())
    return re.compile(pattern)


def written(markup, rng):
    """Some text that a template may stand for, with an accident now and then."""
    words, keep = [], [True]
    for token in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^ \[\]{}]+", markup):
        if token == "[[":
            keep.append(keep[-1] and rng.random() < 0.6)
        elif token == "]]":
            keep.pop()
        elif keep[-1] and token.startswith("{{"):
            low, high = map(int, token[2:-2].split("-"))
            words += rng.choices(["acme", "inc", "the", "license"], k=rng.randint(low, high))
        elif keep[-1]:
            words.append(token)
    if rng.random() < 0.4:
        at = rng.randrange(len(words))
        words[at:at + rng.randint(0, 1)] = rng.choices(["not", "license", "the"], k=rng.randint(0, 1))
    return words


def longest_match(pattern, words):
    """Words of the longest prefix that the whole expression matches."""
    return max((k for k in range(len(words) + 1) if pattern.fullmatch("".join(w + " " for w in words[:k]))), default=None)


def test_automata_against_regular_expressions():
    rng = random.Random(11)
    accepted = 0
    for label, markup in TEMPLATES + (("x", "a b [[c [[d]] {{0-2}}]] e {{1-2}} [[e]] f"), ("y", "a b {{0-3}} [[a b]] c")):
        pattern, automaton = expansion(markup), Automaton(label, markup)
        for _ in range(60):
            text = written(markup, rng) + rng.choices(["of", "the", "license", "f", "e", "c"], k=rng.randint(0, 3))
            want = longest_match(pattern, text)
            assert automaton.run([w.encode() for w in text])[0] == want, (markup, text)
            accepted += want is not None
    assert accepted > 500


def test_usual_notices():
    notices = {
        "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                 "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "lgpl-2-1": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
                    "either version 2.1 of the License, or (at your option) any later version.",
        "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "cc-by-nc": "licensed under the Creative Commons Attribution-NonCommercial 4.0 International License",
    }
    for label, text in notices.items():
        found = scan(text.encode())
        assert label in found["labels"] and found["score"] == 1, label
    assert scan(b"modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 4")["labels"] == []


def test_license_scan_empty(none):
    assert license_scan(none).collect() == []
    assert scan(b"")["labels"] == []


def brute_top(rows, k):
    out = {}
    for i, v in rows.items():
        if i % 2 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows.items() if j != i and len(w) == len(v)))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-3, 3)] * 3), min_size=1, max_size=30), st.integers(1, 6))
def test_threshold_search(vectors, k):
    v = np.array(vectors, float)
    ids = np.arange(len(v))
    for q, (places, scores) in enumerate(threshold_search(v, ids, v, ids, k)):
        want = sorted((-int(v[q] @ v[j]), j) for j in ids if j != q)[:k]
        assert [(-int(s), int(p)) for p, s in zip(places, scores)] == want


def test_threshold_search_large_numbers():
    v = np.array([[2.0**40, 1], [2.0**40, 0], [2.0**40 + 1, -1]])
    (places, scores), = threshold_search(v, np.arange(3), v[:1], np.array([0]), 2)
    assert places.tolist() == [2, 1] and int(scores[0]) == 2**80 + 2**40 - 1


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 2)], "x") for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5], "same") for i in range(40)]
    rows += [(300, None, ""), (302, [1.0, None, 0.0, 0.0], ""), (304, [float("nan")] * 4, ""), (306, [float("inf"), 0.0, 0.0, 0.0], ""), (308, [1.0, 2.0], ""), (None, [1.0] * 4, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    sound = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v, _ in rows if i is not None and i < 300}
    got = {}
    for r in top_k(df, df.vec_id % 2 == 0, k=5, candidates=50, queries=30).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute_top(sound, 5)
    assert {q: [x[k] for k in sorted(x)] for q, x in got.items()} == want
    assert top_k(df.where("false"), df.vec_id % 2 == 0).collect() == []

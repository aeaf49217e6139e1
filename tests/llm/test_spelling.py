"""Spelling variants against all pairs, and the windows of grams against every single edit."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from walkweave.llm.common import table
from walkweave.llm.queries import QUERIES
from walkweave.llm.spelling import Decomposer, longest, near_words, spelling_variants, words


def brute_words(rows, least=6, slip=199):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            out[run[:h % len(run)] + run[h % len(run) + 1:] if h % slip == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute_near(vocabulary):
    """Near words by deleted places (equal lengths share one, unequal ones are one), each held against the definition."""
    holes, near = defaultdict(set), defaultdict(set)
    for w in vocabulary:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1:]].add(w)
    for group in holes.values():
        for a in group:
            near[a] |= group - {a}
    for w in vocabulary:
        for i in range(len(w)):
            v = w[:i] + w[i + 1:]
            if v in vocabulary:
                near[w].add(v)
                near[v].add(w)
    assert all(one_edit(a, b) for a in near for b in near[a])
    return near


def brute(vocabulary, ratio=5):
    near, form = brute_near(vocabulary), {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= ratio * n else None
    out = {}
    for w, n in vocabulary.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), vocabulary[form[w]] if form[w] else None)
    return out


def result(df):
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def test_words(spark):
    rows = [(1, "Straße NAÏVE naïve naïveté ÀÉÎ×÷ÿ abcdefg_hijklmn"), (None, "abcdef abcdef"), (2, None), (2, ""), (3, "x" * 100_000 + " Ābcdefg ABCDEFG")]
    rows += [(k, "abcdefgh ABCDEFGH spelling") for k in range(600)]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n long, word string")
    got = {r.word: r.n for r in words(docs, slip=199).collect()}
    assert got == brute_words(rows) and any(len(w) == 7 and w in "abcdefgh" for w in got)
    plain = {r.word: r.n for r in words(docs, least=3, letters="a-z").collect()}
    assert plain["abcdefgh"] == 1200 and plain["stra"] == 1 and "na" not in plain
    assert words(docs.where("false")).collect() == []


ALPHABET = "abé"


@settings(max_examples=200, deadline=None)
@given(st.text(ALPHABET, min_size=6, max_size=12), st.dictionaries(st.text(ALPHABET + "\x02\x03", min_size=2, max_size=5), st.integers(1, 9), max_size=40))
def test_windows_hold_for_every_edit(word, grams):
    size = len(word)
    most = longest(size)
    grams = {g: n for g, n in grams.items() if len(g) <= most and all(g[:k] in grams for k in range(2, len(g)))}
    tool = Decomposer(grams, most)
    (p, a), (q, b) = tool.probes(word)
    marked = "\x02" + word + "\x03"
    edits = {word[:i] + c + word[i + 1:] for i in range(size) for c in ALPHABET} | {word[:i] + c + word[i:] for i in range(size + 1) for c in ALPHABET}
    for other in edits - {word}:
        t = "\x02" + other + "\x03"
        kept = {(x, t[x:x + k]) for x, k, _, _ in tool.grams_of(other)}
        assert (p, marked[p:p + a]) in kept or (q + len(other) - size, marked[q:q + b]) in kept


@pytest.mark.parametrize("extend", [3, 40, 10_000])
@pytest.mark.parametrize("block", [1, 2_000])
def test_near_words_lose_nothing(spark, sf, block, extend):
    vocabulary = {w: n for w, n in brute_words([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]).items() if n >= 3}
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    got = near_words(df, 6, block, extend).collect()
    want = {frozenset((a, b)) for a, near in brute_near(vocabulary).items() for b in near}
    assert {frozenset((r.a, r.b)) for r in got} == want and len(got) == len(want) > 100
    assert all(r.n_a == vocabulary[r.a] and r.n_b == vocabulary[r.b] for r in got)


def test_query_on_whole_tables(spark, sf):
    vocabulary = {w: n for w, n in brute_words([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]).items() if n >= 5}
    assert result(QUERIES["op13_spelling"](spark, sf)) == brute(vocabulary)


def test_chains_ties_and_odd_words(spark):
    vocabulary = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "abcdef": 1, "abcdeg": 7, "abcdeh": 7, "zzzzzz": 3, "zzzzzzz": 14,
                  "éééééé": 1, "ééééé÷": 9, "y" * 300: 1, "y" * 301: 6, "ab" * 400: 2, "single": 9}
    df = spark.createDataFrame([(w, n, 0, "x") for w, n in vocabulary.items()], "word string, n long, n_near int, form string")
    got = result(spelling_variants(df))
    assert got == brute(vocabulary) and got["aaaaaa"][1] == "aaabbb" and got["abcdef"][0] == "abcdeg"
    assert spelling_variants(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(df, least=3)


def test_one_very_common_beginning(spark):
    """All words share both ends, so every list is long."""
    vocabulary = {f"commonstart{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}commonend": 1 + (a * b + c) % 60 for a in range(12) for b in range(12) for c in range(12)}
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    assert result(spelling_variants(df)) == brute(vocabulary)

"""Where the labels say nothing about words, no text is rejected."""

import random

import numpy as np

from walkweave.llm import toxicity


def tables(spark, texts, labels):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")


def rejected(docs, labels):
    return sum(r.toxic for r in toxicity.severity(docs, toxicity.fit(docs, labels)).collect())


def test_cut_against_rejecting_nothing():
    toxic = np.arange(400) % 5 == 0
    rng = np.random.default_rng(1)
    assert toxicity.place_cut(np.full(400, 0.2), toxic, 4.0) == 4.0
    assert toxicity.place_cut(rng.uniform(size=400), toxic, 4.0) == 4.0
    assert toxicity.place_cut(rng.uniform(size=400), ~toxic, 4.0) == 4.0
    told = np.where(toxic, 1.5, 0.1) + rng.uniform(0, 0.05, 400)
    assert 0.15 < toxicity.place_cut(told, toxic, 4.0) < 1.5


def test_labels_that_no_word_explains(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(40)) for _ in range(400)]
    assert rejected(*tables(spark, texts, [int(rng.random() < 0.2) for _ in texts])) == 0


def test_labels_on_copies_of_a_few_texts(spark):
    rng = random.Random(3)
    few = [" ".join(f"v{rng.randrange(50)}" for _ in range(30)) for _ in range(8)]
    docs, labels = tables(spark, [few[k % 8] for k in range(320)] + ["quite another text"] * 20, [int(k % 8 < 2) for k in range(320)])
    assert rejected(docs, labels) == 0
    spaceless = tables(spark, [t.replace(" ", "") for t in few] * 20, [int(k % 8 < 2) for k in range(160)])
    assert rejected(*spaceless) == 0


def test_word_behind_one_word(spark):
    """A fixed insult, and a word that begins the texts: one word before it, many texts."""
    rng = random.Random(5)
    plain = [" ".join(f"w{rng.randrange(400)}" for _ in range(40)) for _ in range(600)]
    said = [("vermin " + t if k % 20 else t + " you utter vermin") if k % 10 == 0 else t for k, t in enumerate(plain)]
    docs, labels = tables(spark, said, [int(k % 10 == 0) for k in range(600)])
    out = {r.doc_id: r.toxic for r in toxicity.severity(docs, toxicity.fit(docs, labels)).collect()}
    assert sum(out[k] == (k % 10 == 0) for k in range(600)) >= 597


def test_copies_are_one_text(spark):
    rng = random.Random(8)
    texts = ["odd crank words of one text"] * 60 + [" ".join(f"w{rng.randrange(60)}" for _ in range(30)) for _ in range(300)]
    docs, labels = tables(spark, texts, [1] * 60 + [int(rng.random() < 0.1) for _ in range(300)])
    assert b"crank" not in toxicity.fit(docs, labels).weights

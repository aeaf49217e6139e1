"""Severity grades by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of
from .words import words

#: Bounds of the fit: labelled texts, words as features, different texts with a word at least.
SAMPLE, FEATURES, SUPPORT = 8_000, 4_000, 5
#: Parts of the labelled texts, by hash of their id; the cut is placed on severities from fits without a text's own part.
FOLDS = 4
#: Standard errors by which a word's toxic share must differ from that of all.
DEVIATION = 4.0
GRADES = 4


#: Bytes of a word's beginning that are a feature of their own.
STEM = 6


def tokens(text: bytes):
    """The words of a text, each followed by its beginning if it is longer than that."""
    for w in words(text):
        yield w
        if len(w) > STEM:
            yield b"^" + w[:STEM]


@dataclass(frozen=True)
class Ordinal:
    """P(grade > k) = sigmoid(w x - threshold k), with one w for all thresholds; x is ln(1 + count) of each word or beginning."""

    weights: dict[bytes, float]
    thresholds: tuple[float, ...]
    cut: float

    def above(self, text: bytes) -> np.ndarray:
        counts: dict[bytes, int] = {}
        known = self.weights
        for w in words(text):
            if w in known:
                counts[w] = counts.get(w, 0) + 1
            if len(w) > STEM and (w := b"^" + w[:STEM]) in known:
                counts[w] = counts.get(w, 0) + 1
        z = sum(known[w] * log1p(n) for w, n in counts.items())
        return 1 / (1 + np.exp(-np.clip(z - np.array(self.thresholds), -40, 40)))


def fit_cumulative_link(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, features: int, classes: int, ridge: float = 0.1, steps: int = 200):
    """Weights and ascending thresholds that maximise the likelihood less ``ridge`` / 2 of the squared weights (Adam)."""
    at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    index = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, int)
    value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    n = max(1, len(rows))
    w = np.zeros(features)
    # Thresholds by their first and the logs of their gaps, begun at the grades' own shares.
    share = np.array([np.clip((grades > k).mean() if len(rows) else 0.5, 0.5 / n, 1 - 0.5 / n) for k in range(classes - 1)])
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 0.1 * np.arange(classes - 1))
    gaps = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 0.1))))
    params = np.concatenate((w, gaps))
    m = v2 = np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        w, gaps = params[:features], params[features:]
        width = np.exp(gaps[1:])
        theta = np.concatenate((gaps[:1], gaps[0] + np.cumsum(width)))
        z = np.bincount(at, value * w[index], len(rows))
        upper = sigmoid(np.append(theta, np.inf)[grades] - z)
        lower = sigmoid(np.insert(theta, 0, -np.inf)[grades] - z)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        dz = (du - dl) / p
        gw = np.bincount(index, value * dz[at], features) + ridge * w
        gt = np.zeros(classes)
        np.add.at(gt, np.minimum(grades, classes - 1), -du / p)
        low = np.zeros(classes)
        np.add.at(low, np.maximum(grades - 1, 0), np.where(grades > 0, dl / p, 0))
        gt = gt[:-1] + low[:-1]
        ggap = np.concatenate(([gt.sum()], [gt[k + 1:].sum() * width[k] for k in range(classes - 2)]))
        g = np.concatenate((gw, ggap)) / n
        m, v2 = 0.9 * m + 0.1 * g, 0.99 * v2 + 0.01 * g * g
        params = params - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v2 / (1 - 0.99**t)) + 1e-8)
    w, gaps = params[:features], params[features:]
    return w, np.concatenate((gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, doc_id: str, text: str, label: str) -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` labelled documents, those of the least hashes of their ids."""
    chosen = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
              .orderBy(F.xxhash64(doc_id), doc_id).limit(sample))
    return (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
            .join(F.broadcast(chosen.withColumnRenamed(doc_id, "doc_id")), "doc_id"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, label, word, n, print) of the sample; print: the fingerprint of the text."""

    def run(batches):
        for batch in rows_of(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for d, y, t, p in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text", "print")), strict=True):
                counts: dict[bytes, int] = {}
                for w in tokens(t or b""):
                    counts[w] = counts.get(w, 0) + 1
                for w, n in counts.items():
                    for c, x in zip(out, (d, y, w, n, p), strict=True):
                        c.append(x)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()), strict=True)],
                                  ["doc_id", "label", "word", "n", "print"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text", "print").mapInArrow(
        run, "doc_id long, label int, word binary, n int, print long")


def place_cut(severities: np.ndarray, toxic: np.ndarray, nothing: float) -> float:
    """The cut with the best F1, the highest among equal ones, or ``nothing`` if no cut is better than rejecting nothing.

    A cut is better if it rejects more toxic texts than clean ones and their share is DEVIATION standard errors above that
    of all texts.
    """
    share, best, cut = toxic.mean(), 0.0, nothing
    for c in np.unique(np.round(severities, 3)):
        said = severities >= c
        n, hit = said.sum(), (said & toxic).sum()
        if 2 * hit <= n or hit - n * share < DEVIATION * np.sqrt(n * share * (1 - share)):
            continue
        f1 = 2 * hit / (n + toxic.sum())
        if f1 >= best:
            best, cut = f1, float(c)
    # Between the texts on both sides of the cut.
    below = severities[severities < cut]
    return (cut + below.max()) / 2 if best > 0 and len(below) else cut


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE,
        features: int = FEATURES) -> Ordinal:
    """The model of a labelled corpus, fitted on a bounded sample of it (``sample`` texts, ``features`` words).

    The labels say toxic or not. Grade 0 is not toxic; toxic texts are graded 1 to 3 by how many hostile words they hold
    (up to the lower tercile of toxic texts with such words, up to the upper one, more), hostile being words at least 20
    times as frequent among toxic texts. Labels of three values or more are taken as the grades themselves. The cut on
    the expected severity is the one with the best F1 on severities from fits that left the text out, the highest among
    equal ones. Without labels, with labels of one kind, without a word that tells them apart, or if no cut is better than
    rejecting nothing (``place_cut``), nothing is rejected.
    """
    chosen = labelled_sample(docs, labels, sample, doc_id, text, label).withColumn("print", F.xxhash64("text"))
    # Copies of a text are one text to what tells of a word.
    texts: dict[int, int] = {}
    size: dict[int, int] = {}
    for y, p, n in chosen.groupBy("label", "print").count().collect():
        size[y] = size.get(y, 0) + n
        texts[p] = max(texts.get(p, 0), int(y > 0))
    if len(size) < 2:
        return Ordinal({}, tuple(float(5 + k) for k in range(GRADES - 1)), float(GRADES))
    total, bad = len(texts), sum(texts.values())
    if bad in (0, total):
        return Ordinal({}, tuple(float(5 + k) for k in range(GRADES - 1)), float(GRADES))
    counts = word_counts(chosen)
    seen = counts.groupBy("word", "print").agg(F.max((F.col("label") > 0).cast("long")).alias("bad"))
    df = seen.groupBy("word").agg(F.count("*").alias("df"), F.sum("bad").alias("bad"))
    # Deviation of the toxic share among them, in standard errors; words within DEVIATION of it tell nothing.
    share = bad / total
    z = (F.col("bad") - F.col("df") * share) / F.sqrt(F.col("df") * share * (1 - share))
    picked = (df.where(F.col("df") >= SUPPORT).select("word", "df", "bad", z.alias("z")).where(F.abs("z") >= DEVIATION)
              .orderBy(F.desc(F.abs("z")), "word").limit(features).collect())
    index = {bytes(r["word"]): k for k, r in enumerate(picked)}
    ratio = [(r["bad"] + 0.5) / (bad + 1) / ((r["df"] - r["bad"] + 0.5) / (total - bad + 1)) for r in picked]
    hostile = {k for k, x in enumerate(ratio) if x >= 20}
    # One row per sampled text: its features and their counts.
    numbered = df.sparkSession.createDataFrame([(w, k) for w, k in index.items()], "word binary, k int")
    held = (counts.join(F.broadcast(numbered), "word").groupBy("doc_id").agg(F.collect_list(F.struct("k", "n")).alias("x")))
    rows = (chosen.select("doc_id", "label", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FOLDS)).alias("fold")).distinct()
            .join(held, "doc_id", "left").orderBy("doc_id").collect())
    x = [(np.array([p["k"] for p in r["x"] or []], int), np.log1p(np.array([p["n"] for p in r["x"] or []], float))) for r in rows]
    y = np.array([r["label"] for r in rows], int)
    if len(size) > 2:
        levels = sorted(size)
        grades = np.array([levels.index(v) for v in y])
    else:
        hits = np.array([sum(p["n"] for p in r["x"] or [] if p["k"] in hostile) for r in rows])
        toxic = hits[(y > 0) & (hits > 0)]
        one, two = np.quantile(toxic, [1 / 3, 2 / 3]) if len(toxic) else (1, 2)
        grades = np.where(y > 0, 1 + (hits > one) + (hits > max(two, one + 1)), 0)
    classes = int(max(grades.max() + 1, 2))
    fold = np.array([r["fold"] for r in rows])

    def severities(w, theta, part):
        z = np.array([v @ w[k] if len(k) else 0.0 for k, v in part])
        return (1 / (1 + np.exp(-np.clip(z[:, None] - theta[None, :], -40, 40)))).sum(1)

    outside = np.zeros(len(rows))
    for f in range(FOLDS):
        held = fold == f
        fitted = fit_cumulative_link([a for a, h in zip(x, held, strict=True) if not h], grades[~held], len(index), classes)
        outside[held] = severities(*fitted, [a for a, h in zip(x, held, strict=True) if h])
    w, theta = fit_cumulative_link(x, grades, len(index), classes)
    cut = place_cut(outside, y > 0, float(classes)) if index else float(classes)
    return Ordinal({k: float(w[i]) for k, i in index.items() if abs(w[i]) > 1e-6}, tuple(map(float, theta)), float(cut))


def severity(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``severity`` (the expected grade), ``grade`` (the likeliest), ``toxic`` (severity
    at the model's cut or above).

    Every word of the text counts. Null and empty texts have the severity of a text without any known word and are never
    toxic; repeated rows stay; an empty table gives an empty result. Columns of these names are replaced.
    """
    own = [c for c in docs.columns if c not in ("severity", "grade", "toxic")]
    schema = docs.select(F.struct(*own).alias("row")).schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for batch in rows_of(batches):
            above = [known.above(t or b"") for t in batch.column("text").to_pylist()]
            mean = [float(a.sum()) for a in above]
            grade = [int(np.argmax(-np.diff(np.concatenate(([1.0], a, [0.0]))))) for a in above]
            toxic = [bool(t) and s >= known.cut for t, s in zip(batch.column("text").to_pylist(), mean, strict=True)]
            yield pa.record_batch([batch.column("row"), pa.array(mean), pa.array(grade, pa.int32()), pa.array(toxic)], ["row", "severity", "grade", "toxic"])

    return (docs.select(F.struct(*own).alias("row"), F.col(text).cast("binary").alias("text"))
            .mapInArrow(run, f"row {schema}, severity double, grade int, toxic boolean").select("row.*", "severity", "grade", "toxic"))

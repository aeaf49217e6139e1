"""Token counts without ids: pieces counted once per distinct pre-token, joined to per-document frequencies, summed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, rows_of, stored, texts_of
from .pretokens import loaded, runs

#: Pre-tokens of this many code points at most can be among the broadcast ones, so HOT * HOT_CHARS bounds that table.
HOT_CHARS = 48
HOT = 200_000


def distinct_pretokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pretoken, n): every distinct pre-token of the column with its number of places, summed per task first."""

    def run(batches):
        tool = loaded(path, True)
        sums: dict[str, int] = {}
        for batch in rows_of(batches):
            for texts in runs([p for t in texts_of(batch) for p in tool.segments(t)[0]]):
                words, number, _ = tool.cut(texts)
                for w, n in zip(words, np.bincount(number, minlength=len(words)).tolist(), strict=True):
                    sums[w] = sums.get(w, 0) + n
            if len(sums) > 300_000:
                yield pa.record_batch([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], ["pretoken", "n"])
                sums = {}
        if sums:
            yield pa.record_batch([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], ["pretoken", "n"])

    return (docs.select(F.col(text).alias("text")).mapInArrow(run, "pretoken string, n long")
            .groupBy("pretoken").agg(F.sum("n").alias("n")))


def piece_counts(pretokens: DataFrame, path: str) -> DataFrame:
    """Adds ``pieces``: the model's pieces of each pre-token."""

    def run(batches):
        tool = loaded(path, True)
        for batch in batches:
            words = batch.column("pretoken").to_pylist()
            yield pa.record_batch([batch.column("pretoken"), batch.column("n"), pa.array([len(tool.pieces(w)) for w in words], pa.int64())],
                                  ["pretoken", "n", "pieces"])

    return pretokens.mapInArrow(run, "pretoken string, n long, pieces long")


def token_counts(docs: DataFrame, path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Tokens of every text under the word tokenizer file ``path``: doc_id, n_bytes, n_tokens, over_limit.

    The ``hot`` most frequent pre-tokens (bounded in number and length) are looked up where the texts are read; the rest
    meet their counts in a shuffled join, so the vocabulary may have any size. One result row per input row, repeated
    rows and repeated or null ids included; null text counts as empty (0 bytes, 0 tokens). Special strings inside a text
    are one token each. An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    counted = stored(piece_counts(distinct_pretokens(docs, path, text), path), "pretokens")
    # The most frequent ones by steps of their counts, as many steps as stay within ``hot``.
    short = counted.where(F.length("pretoken") <= HOT_CHARS).withColumn("step", F.floor(F.log2("n") * 8))
    least, total = None, 0
    for r in sorted(short.groupBy("step").count().collect(), reverse=True):  # eight rows for each doubling of the counts
        total += r["count"]
        if total > hot:
            break
        least = r["step"]
    top = short.where(F.col("step") >= least).select("pretoken", "pieces").collect() if least is not None else []
    known = spark.sparkContext.broadcast({r[0]: r[1] for r in top})

    def run(batches):
        tool, pieces = loaded(path, True), known.value
        part, done = TaskContext.get().partitionId(), 0
        for batch in rows_of(batches):
            texts = texts_of(batch)
            parts, owner, base = [], [], []
            for k, t in enumerate(texts):
                segments, special = tool.segments(t)
                parts += segments
                owner += [k] * len(segments)
                base.append(len(special))
            fixed = np.array(base, np.int64)
            owner = np.array(owner, np.int64)
            keys, words, freq = [], [], []
            seen = 0
            for run_texts in runs(parts):
                distinct, number, counts = tool.cut(run_texts)
                doc = np.repeat(owner[seen:seen + len(run_texts)], counts)
                seen += len(run_texts)
                if not distinct:
                    continue
                size = np.fromiter((pieces.get(w, -1) for w in distinct), np.int64, len(distinct))
                each = size[number]
                fixed += np.bincount(doc[each >= 0], weights=each[each >= 0], minlength=len(texts)).astype(np.int64)
                pairs, n = np.unique(doc[each < 0] * len(distinct) + number[each < 0], return_counts=True)
                keys.append(pairs // len(distinct))
                words += [distinct[i] for i in (pairs % len(distinct)).tolist()]
                freq.append(n)
            rest = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            m, k = len(texts), len(rest)
            none = lambda n: pa.nulls(n, pa.int64())
            first = row_key(part, done)
            done += m
            # A row for each document (its word is one that no text has), then one for each of its rare pre-tokens.
            yield pa.record_batch([
                pa.array(np.concatenate((first + np.arange(m), first + rest))),
                pa.array([f"\x00 {first + i}" for i in range(m)] + words, pa.string()),
                pa.array(np.concatenate((np.zeros(m, np.int64), *freq))),
                pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), none(k)]),
                pa.concat_arrays([pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), none(k)]),
                pa.concat_arrays([pa.array(fixed), none(k)]),
            ], ["key", "pretoken", "freq", "doc_id", "n_bytes", "fixed"])

    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "key long, pretoken string, freq long, doc_id long, n_bytes long, fixed long")
    return (found.join(counted.select("pretoken", "pieces").hint("merge"), "pretoken", "left")
            .groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                (F.max("fixed") + F.coalesce(F.sum(F.col("freq") * F.col("pieces")), F.lit(0))).alias("n_tokens"))
            .select(F.col("doc_id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))

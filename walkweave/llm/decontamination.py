"""Benchmark passages in documents by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkweave.session import cut

from .common import rows_of
from .words import words

#: Words of a window, and windows searched for at once: a larger benchmark takes several searches over the same rows.
WINDOW, CHUNK = 13, 50_000


class WuManber:
    """Search for many word sequences of one length.

    Blocks are two words (one, if the sequences have one). ``shift`` says how far the window may move when it ends in a
    block; a block in none of the sequences moves it past itself. At shift 0 the block's bucket, and in it those with the
    same first block, give the sequences that are compared word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.jump = self.length - self.block + 1
        self.shift: dict[bytes, dict[bytes, int]] = {}
        self.buckets: dict[tuple[bytes, bytes], dict[bytes, list]] = {}
        for p, items in patterns.items():
            for end in range(self.block, self.length + 1):
                first = p[end - 2] if self.block == 2 else b""
                row = self.shift.setdefault(p[end - 1], {})
                row[first] = min(row.get(first, self.jump), self.length - end)
            last = (p[-2] if self.block == 2 else b"", p[-1])
            self.buckets.setdefault(last, {}).setdefault(p[0], []).append((list(p), items))

    def search(self, text: list[bytes]):
        """(start, items) of every occurrence, in order of start."""
        length, two, jump, shift, n = self.length, self.block == 2, self.jump, self.shift, len(text)
        at = length - 1
        while at < n:
            row = shift.get(text[at])
            if row is None:
                at += jump
                continue
            first = text[at - 1] if two else b""
            move = row.get(first, jump)
            if move:
                at += move
                continue
            start = at - length + 1
            for pattern, items in self.buckets[first, text[at]].get(text[start], ()):
                if text[start:at + 1] == pattern:
                    yield start, items
            at += 1


def windows(benchmark: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, length, items): distinct windows of ``size`` words of all items; an item of fewer words, but not none, is one.

    ``window`` has the words joined by spaces. An item without an id goes by the name "null"; null text has no words.
    """

    def run(batches):
        for batch in rows_of(batches):
            out = set()
            for item, t in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                w = words(t or b"")
                for at in range(max(1, len(w) - size + 1) if w else 0):
                    out.add((b" ".join(w[at:at + size]), min(size, len(w)), item))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*sorted(out), strict=True), (pa.binary(), pa.int32(), pa.string()), strict=True)], ["window", "length", "item"])

    return (benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "window binary, length int, item string")
            .groupBy("window", "length").agg(F.array_sort(F.collect_set("item")).alias("items")))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


FOUND = "struct<n_words: bigint, runs: array<struct<start: bigint, end: bigint>>, items: array<string>>"
ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW,
                  share: int = 20, chunk: int = CHUNK) -> DataFrame:
    """All rows and columns of ``docs`` with ``found`` (n_words, runs of hit words as [start, end), items in order),
    ``n_hit`` and ``contaminated`` (some word is hit, and at least one in ``share``).

    Documents are not shuffled. The windows go to the tasks in broadcasts of at most ``chunk`` windows of ``size`` words;
    a larger benchmark makes several searches, one behind the other on the same rows, each adding to what was found. Null
    and empty texts have no words and are clean; an empty benchmark leaves all documents clean; repeated rows stay.
    Columns of ``docs`` named found, n_hit or contaminated are replaced.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("found", "n_hit", "contaminated")]
    schema = docs.select(F.struct(*own).alias("row")).schema["row"].dataType.simpleString()
    all_windows = cut(windows(benchmark, size, item_id, item_text))
    parts = max(1, -(-all_windows.count() // chunk) * 2 if all_windows.count() > chunk else 1)
    state = docs.select(F.struct(*own).alias("row"), F.col(text).cast("binary").alias("text"), F.lit(None).cast(FOUND).alias("found"))
    for k in range(parts):
        rows = all_windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k).collect()
        patterns = spark.sparkContext.broadcast([(bytes(r["window"]), r["items"]) for r in rows])

        def run(batches, patterns=patterns):
            by: dict[int, dict] = {}
            for window, items in patterns.value:
                p = tuple(window.split(b" "))
                by.setdefault(len(p), {})[p] = items
            searches = [WuManber(p) for p in by.values()]
            for batch in rows_of(batches):
                out = []
                for t, old in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                    w = words(t or b"")
                    runs = [(r["start"], r["end"]) for r in old["runs"]] if old else []
                    items = set(old["items"]) if old else set()
                    for s in searches:
                        for start, names in s.search(w):
                            if runs and runs[-1][0] <= start <= runs[-1][1]:
                                runs[-1] = runs[-1][0], max(runs[-1][1], start + s.length)
                            else:
                                runs.append((start, start + s.length))
                            items.update(names)
                    out.append({"n_words": len(w), "runs": [{"start": a, "end": b} for a, b in merged(runs)], "items": sorted(items)})
                yield pa.record_batch([batch.column("row"), batch.column("text"), pa.array(out, ARROW)], ["row", "text", "found"])

        state = state.mapInArrow(run, f"row {schema}, text binary, found {FOUND}")
    hit = F.aggregate("found.runs", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return (state.select("row.*", "found").withColumn("n_hit", hit)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("found.n_words"))))

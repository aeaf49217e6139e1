"""Spelling variants of words by a variable-length gram index.

Frequent grams are too common to tell words apart, rare ones need not be long: a dictionary keeps a gram only if the gram
without its last character is frequent, and each word is decomposed into the longest dictionary grams. An edit can only
touch the grams whose window it lies in, so two grams with separate windows are never both touched by one edit: a word
merges just two lists, the rarest such pair, and every near word is in one of them. What the lists bring is verified.

Words of length c meet words of length c and c + 1 under a dictionary of their own, whose grams have at most (c + 2) / 2
characters; then the first and the last gram of a word always have separate windows, so no word needs another way.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, stored, texts_of

#: Shortest and longest gram.
SHORTEST, LONGEST = 2, 8
#: A gram is extended if it makes up more than one in EXTEND of its length's places; extensions below a quarter of that are
#: left out. So a dictionary has at most 4 * EXTEND grams of each length.
EXTEND = 10_000
#: Words of a list that meet at once; longer lists are dealt out in blocks.
BLOCK = 2_000
#: Words or grams that a task counts before it hands them on.
HELD = 300_000
#: Marks of the start and the end of a word.
START, END = "\x02", "\x03"

LATIN = "A-Za-zÀ-ÿ"
LOWER = {c: c + 32 for c in range(65, 91)}


def words(docs: DataFrame, least: int = 6, slip: int | None = None, letters: str = LATIN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): maximal runs of ``letters`` of ``least`` code points or more, A-Z lowered, with their number of places.

    With ``slip``, a run whose crc32 with its document (``<doc_id>:<run>``, a null id being empty) is divisible by it loses
    the code point at crc32 modulo its length, all its places in that document alike. Null text has no words.
    """
    run = re.compile(f"[{letters}]{{{least},}}")

    def count(batches):
        sums: Counter[str] = Counter()
        for batch in rows_of(batches):
            for name, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                found = Counter(run.findall(t.translate(LOWER)))
                if slip:
                    prefix = zlib.crc32(f"{'' if name is None else name}:".encode())
                    for w, n in found.items():
                        h = zlib.crc32(w.encode(), prefix)
                        if h % slip == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                        sums[w] += n
                else:
                    sums.update(found)
                if len(sums) > HELD:
                    yield pa.record_batch([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], ["word", "n"])
                    sums = Counter()
        if sums:
            yield pa.record_batch([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], ["word", "n"])

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word") >= least)


def longest(size: int) -> int:
    """Longest gram for pairs whose shorter word has ``size`` code points."""
    return min(LONGEST, (size + 2) // 2)


def _kind(size: int) -> int:
    """The dictionary of a size: sizes with the longest grams share one."""
    return min(size, 2 * LONGEST - 2)


def gram_dictionary(vocabulary: DataFrame, least: int, extend: int = EXTEND) -> DataFrame:
    """(kind, gram, n): the grams kept for each kind, pruned by frequency; every gram's beginning is kept with it."""

    def count(batches):
        sums: Counter[tuple[int, str]] = Counter()
        for batch in batches:
            for w in batch.column("word").to_pylist():
                s = START + w + END
                for kind in {_kind(c) for c in (len(w), len(w) - 1) if c >= least}:
                    for q in range(SHORTEST, longest(kind) + 1):
                        sums.update((kind, s[p:p + q]) for p in range(len(s) - q + 1))
                if len(sums) > HELD:
                    yield _grams(sums)
                    sums = Counter()
        if sums:
            yield _grams(sums)

    counted = stored(vocabulary.select("word").mapInArrow(count, "kind int, gram string, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n")), "grams")
    places = counted.where(F.length("gram") == SHORTEST).groupBy("kind").agg((F.sum("n") / extend).alias("frequent"))
    known = counted.join(F.broadcast(places), "kind")  # at most 2 * LONGEST kinds
    beginnings = known.where("n > frequent").select("kind", F.col("gram").alias("beginning"))
    kept = known.where(F.col("n") >= F.col("frequent") / 4)
    short = kept.where(F.length("gram") == SHORTEST)
    more = kept.where(F.length("gram") > SHORTEST).withColumn("beginning", F.expr("left(gram, length(gram) - 1)"))
    return short.select("kind", "gram", "n").union(more.join(beginnings, ["kind", "beginning"], "left_semi").select("kind", "gram", "n"))


def _grams(sums) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k for k, _ in sums], pa.int32()), pa.array([g for _, g in sums], pa.string()), pa.array(sums.values(), pa.int64())],
                           ["kind", "gram", "n"])


class Decomposer:
    """Variable grams of words under one kind's dictionary (gram -> number of places)."""

    def __init__(self, grams: dict[str, int], most: int):
        self.grams, self.most = grams, most
        self.open = {g[:-1] for g in grams if len(g) > SHORTEST}
        self.rare = min(grams.values(), default=1)

    def grams_of(self, word: str) -> list[tuple[int, int, int, int]]:
        """(start, length, first, last) of each gram of the marked word that lies in no earlier one; an edit outside the
        places first..last leaves the gram as it is.

        The walk from a start reads on while a longer gram may be known, so an edit behind what it read changes nothing; and
        a changed gram can only swallow this one if it reaches from the edit to this one's end, ``most`` places at most.
        """
        s = START + word + END
        found, reach = [], -1
        for p in range(len(s) - SHORTEST + 1):
            size = SHORTEST
            while size < self.most and s[p:p + size] in self.open and s[p:p + size + 1] in self.grams and p + size < len(s):
                size += 1
            read = size + 1 if size < self.most and s[p:p + size] in self.open else size
            if p + size > reach:
                found.append((p, size, p + size - self.most, p + read - 1))
                reach = p + size
        return found

    def probes(self, word: str) -> tuple[tuple[int, int], tuple[int, int]]:
        """Start and length of two grams with separate windows, of the least number of places together."""
        s, found = START + word + END, self.grams_of(word)
        cost = [self.grams.get(s[p:p + size], self.rare) for p, size, _, _ in found]
        best = None
        for a, (p, size, _, last) in enumerate(found):
            for b in range(a + 1, len(found)):
                if found[b][2] > last and (best is None or cost[a] + cost[b] < best[0]):
                    best = cost[a] + cost[b], (p, size), found[b][:2]
        return best[1:]


def postings(vocabulary: DataFrame, dictionary: DataFrame, least: int) -> DataFrame:
    """(word, n, probes, lists): keys of the two lists that a word merges, and of all lists that it may be found in.

    A gram before the edit keeps its place from the start, one behind it its place from the end, so keys hold (size of the
    shorter word, side, place, gram).
    """
    kept: dict[int, dict[str, int]] = {}
    for r in dictionary.collect():  # bounded: 4 * EXTEND grams of each length, LONGEST lengths, 2 * LONGEST kinds
        kept.setdefault(r.kind, {})[r.gram] = r.n
    shared = vocabulary.sparkSession.sparkContext.broadcast(kept)

    def run(batches):
        tools = {k: Decomposer(shared.value.get(k, {}), longest(k)) for k in range(least, _kind(2 * LONGEST) + 1)}
        for batch in batches:
            probes, lists = [], []
            for w in batch.column("word").to_pylist():
                s, keys = START + w + END, []
                for c in (len(w), len(w) - 1):
                    if c < least:
                        continue
                    tool = tools[_kind(c)]
                    for p, size, first, last in tool.grams_of(w):
                        if last < len(s) - tool.most:  # else no other gram has a window behind it
                            keys.append(f"{c}<{p} {s[p:p + size]}")
                        if first >= SHORTEST:  # nor before it
                            keys.append(f"{c}>{len(s) - p} {s[p:p + size]}")
                tool = tools[_kind(len(w))]
                (p, size), (q, other) = tool.probes(w)
                probes.append([f"{len(w)}<{p} {s[p:p + size]}", f"{len(w)}>{len(s) - q} {s[q:q + other]}"])
                lists.append(keys)
            yield pa.record_batch([batch.column("word"), batch.column("n"), pa.array(probes, pa.list_(pa.string())), pa.array(lists, pa.list_(pa.string()))],
                                  ["word", "n", "probes", "lists"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, probes array<string>, lists array<string>")


def near_words(vocabulary: DataFrame, least: int, block: int = BLOCK, extend: int = EXTEND) -> DataFrame:
    """(a, n_a, b, n_b): every two words of (word, n) that differ by one inserted, deleted or replaced code point, once."""
    posted = stored(postings(vocabulary, gram_dictionary(vocabulary, least, extend), least), "postings")
    lists = posted.select(F.explode("lists").alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    probes = posted.select(F.explode("probes").alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    long = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block).select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    long = stored(long, "long-lists")
    lists = lists.join(long, "key", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("b"), F.col("blocks")), F.lit(0)).cast("int")).drop("blocks")
    probes = probes.join(long, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0))))).drop("blocks")
    ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    met = probes.join(lists.hint("merge"), ["key", "block"]).where(ordered & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def spelling_variants(vocabulary: DataFrame, least: int = 6, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (word, n).

    ``form`` is the near word of the largest n (of equal ones the first in code-point order) if that is ``ratio`` times the
    word's own at least, ``root`` where forms lead to. Words are distinct, not null, of ``least`` code points at least and
    counted at least once; ``least`` is 4 or more. An empty vocabulary gives an empty result; further columns are ignored.
    """
    if least < 2 * SHORTEST or ratio < 2:
        raise ValueError("words of four code points at least, and a ratio of two at least")
    vocabulary = stored(vocabulary.select("word", "n"), "vocabulary")
    pairs = near_words(vocabulary, least)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")),
                                           F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    taken = -F.col("best.m") >= ratio * F.col("n")
    formed = stored(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n")), "forms")
    # Counts grow by the ratio from form to form, so a few doublings of the pointers reach every root.
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        jump = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(links.join(jump, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

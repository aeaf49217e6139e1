"""BPE encoding and decoding over a distinct-word table.

Texts are split into words in Spark tasks and every distinct word of the corpus is encoded once. The most frequent words
(``HOT_BYTES`` of words and ids at most) have numbers that every task knows; when texts are split again, a text becomes the
numbers of its words, with gaps for the others. Those meet their ids in a shuffled join by word and fall back into their
gaps by position. Decoding joins ids to the pieces of the vocabulary.

Texts are known by a 128-bit digest, so nothing depends on the order in which rows are read again, and copies of a text are
put together once however many there are.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of, stored, texts_of
from .pretokens import Pretokens, byte_alphabet, loaded, runs, within

#: Bytes of the broadcast words and ids together.
HOT_BYTES = 12_000_000
#: Words that a task counts before it hands them on.
HELD = 300_000
#: Tokens put together at once.
TOKENS = 2_000_000


def digest(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def _parts(tool: Pretokens, texts: list[str]) -> tuple[list[str], list[int], dict[int, list[str]]]:
    """Parts of the texts in normal form, the text of each, and the special strings that follow a part."""
    special = re.compile("|".join(re.escape(s) for s in sorted(tool.specials, key=len, reverse=True)) or r"(?!)")
    parts, owner, follows = [], [], {}
    for k, text in enumerate(texts):
        at = 0
        for found in special.finditer(text) if any(s in text for s in tool.specials) else ():
            cut = list(within(tool.normal(text[at:found.start()])))
            parts += cut
            owner += [k] * len(cut)
            follows.setdefault(len(parts) - 1, []).append(found.group())
            at = found.end()
        cut = list(within(tool.normal(text[at:])))
        parts += cut
        owner += [k] * len(cut)
    return parts, owner, follows


def distinct_words(docs: DataFrame, path: str, words: bool = True, text: str = "text") -> DataFrame:
    """(word, n, ids): every distinct word of the column with its number of places and its ids (little-endian, of two bytes
    where the vocabulary allows), each word encoded once. A special string is a word of its own."""

    def count(batches):
        tool, sums = loaded(path, words), {}
        for batch in rows_of(batches):
            parts, _, follows = _parts(tool, texts_of(batch))
            for run in runs(parts):
                distinct, number, _ = tool.cut(run)
                for w, n in zip(distinct, np.bincount(number, minlength=len(distinct)).tolist(), strict=True):
                    sums[w] = sums.get(w, 0) + n
            for w in (w for some in follows.values() for w in some):
                sums[w] = sums.get(w, 0) + 1
            if len(sums) > HELD:
                yield pa.record_batch([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], ["word", "n"])
                sums = {}
        if sums:
            yield pa.record_batch([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], ["word", "n"])

    def encode(batches):
        tool = loaded(path, words)
        for batch in batches:
            code = "H" if _width(tool).itemsize == 2 else "I"
            ids = [array(code, [tool.specials[w]] if w in tool.specials else tool.pieces(w)).tobytes() for w in batch.column("word").to_pylist()]
            yield pa.record_batch([batch.column("word"), batch.column("n"), pa.array(ids, pa.binary())], ["word", "n", "ids"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(encode, "word string, n long, ids binary")


def _width(tool: Pretokens) -> np.dtype:
    return np.dtype("<u2" if tool.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


def _short(number: int) -> bytes:
    """One number as ``_varints`` writes it."""
    out = bytearray()
    while number > 127:
        out.append(number & 127 | 128)
        number >>= 7
    out.append(number)
    return bytes(out)


def _varints(numbers: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Numbers below 2^28 in seven bits a byte, the lowest first; one value for each part between ``bounds``."""
    x = numbers.astype(np.uint32)
    size = np.ones(len(x), np.int64)
    for k in (7, 14, 21):
        size += x >> k > 0
    ends = np.cumsum(size)
    out, start = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8), ends - size
    for k in range(4):
        there = np.flatnonzero(size > k) if k else slice(None)
        part = x[there] >> 7 * k
        out[start[there] + k] = part & 127 | np.where(size[there] > k + 1, 128, 0).astype(np.uint32)
    cuts = np.concatenate(([0], ends))[bounds].tolist()
    return [out[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]


def _numbers(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in the parts of ``_varints``, and the bounds of each part's numbers."""
    b = np.frombuffer(b"".join(parts), np.uint8)
    ended = b < 128
    last = np.flatnonzero(ended)
    first = np.concatenate(([0], last[:-1] + 1)) if last.size else last
    out = (b[first] & 127).astype(np.int64)
    more = np.flatnonzero(last > first)
    for k in (1, 2, 3):
        more = more[first[more] + k <= last[more]]
        out[more] |= (b[first[more] + k] & 127).astype(np.int64) << 7 * k
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return out, np.searchsorted(last, np.concatenate(([0], np.cumsum(sizes))))


class Known:
    """The most frequent words: their numbers from 1 on, the commonest first, and their ids one after the other."""

    def __init__(self, words: list[str], ids: list[bytes], width: np.dtype):
        self.words, self.width = words, width
        self.sizes = np.array([0, *map(len, ids)], np.int64) // width.itemsize
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(ids), width)
        self._numbers: dict[str, int] | None = None

    def numbers(self) -> dict[str, int]:
        if self._numbers is None:
            self._numbers = {w: k for k, w in enumerate(self.words, 1)}
        return self._numbers


def _most_frequent(table: DataFrame, limit: int, width: np.dtype) -> Known:
    """Words by steps of their counts, as many steps as stay within ``limit`` bytes of words and ids."""
    stepped = table.withColumn("step", F.floor(F.log2("n") * 8)).withColumn("size", F.octet_length("word") + F.octet_length("ids"))
    least, total = None, 0
    for r in sorted(stepped.groupBy("step").agg(F.sum("size").alias("size")).collect(), reverse=True):  # eight rows a doubling
        total += r["size"]
        if total > limit:
            break
        least = r["step"]
    if least is None:
        return Known([], [], width)
    top = stepped.where(F.col("step") >= least).select("word", "ids", "n").toArrow().sort_by([("n", "descending")])
    return Known(top.column("word").to_pylist(), top.column("ids").to_pylist(), width)


def _numbered(tool: Pretokens, known: dict[str, int], texts: list[str]):
    """For each text: the numbers of its words in order, 0 for a word that has none, and those words."""
    parts, owner, follows = _parts(tool, texts)
    numbers: list[list[np.ndarray]] = [[] for _ in texts]
    rare: list[list[str]] = [[] for _ in texts]
    seen = 0
    for run in runs(parts):
        distinct, number, counts = tool.cut(run)
        each = np.fromiter((known.get(w, 0) for w in distinct), np.int64, len(distinct))[number]
        left = np.flatnonzero(each == 0)
        at = np.concatenate(([0], np.cumsum(counts)))
        lefts, at = np.searchsorted(left, at).tolist(), at.tolist()
        names = [distinct[i] for i in number[left].tolist()]
        for j in range(len(run)):
            k = owner[seen + j]
            numbers[k].append(each[at[j]:at[j + 1]])
            rare[k] += names[lefts[j]:lefts[j + 1]]
            for s in follows.get(seen + j, ()):
                numbers[k].append(np.array([known.get(s, 0)]))
                if s not in known:
                    rare[k].append(s)
        seen += len(run)
    return [np.concatenate(x) for x in numbers], rare


#: Between the words that a text's gaps stand for; no word holds white space or a NUL beside it.
GAP_MARK = "\x00\n"


def encoded_texts(docs: DataFrame, path: str, words: bool = True, text: str = "text", hot_bytes: int = HOT_BYTES, decoded: bool = False) -> DataFrame:
    """(digest, ids): each distinct text of the column with its ids as little-endian unsigned 32-bit integers; with ``decoded``
    also the text that these ids decode to."""
    table = stored(distinct_words(docs, path, words, text), "words")
    known = docs.sparkSession.sparkContext.broadcast(_most_frequent(table, hot_bytes, _width(loaded(path, words))))

    def split(batches):
        tool, squeeze, numbers = loaded(path, words), zstandard.ZstdCompressor(level=1), known.value.numbers()
        for batch in rows_of(batches):
            once = {_digest(t): t for t in texts_of(batch)}
            found, rare = _numbered(tool, numbers, list(once.values()))
            bodies = _varints(np.concatenate(found), np.cumsum([0, *map(len, found)]))
            packed = [squeeze.compress(len(x).to_bytes(8, "little") + x + GAP_MARK.join(r).encode()) for x, r in zip(bodies, rare, strict=True)]
            yield pa.record_batch([pa.array(once.keys(), pa.binary()), pa.array(packed, pa.binary())], ["digest", "packed"])

    def unpacked(raw: bytes, loosen) -> tuple[bytes, bytes]:
        whole = loosen.decompress(raw)
        size = 8 + int.from_bytes(whole[:8], "little")
        return whole[8:size], whole[size:]

    def rare_words(batches):
        loosen = zstandard.ZstdDecompressor()
        for batch in rows_of(batches):
            keys, names, gaps = [], [], []
            for key, raw in zip(batch.column("digest").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                rest = unpacked(raw, loosen)[1]
                at: dict[str, bytearray] = {}
                for k, w in enumerate(rest.decode().split(GAP_MARK) if rest else ()):
                    at.setdefault(w, bytearray()).extend(_short(k))
                keys += [key] * len(at)
                names += at.keys()
                gaps += map(bytes, at.values())
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(names, pa.string()), pa.array(gaps, pa.binary())],
                                  ["digest", "word", "gaps"])

    def filled(batches):
        loosen, before = zstandard.ZstdDecompressor(), None
        pieces = Pieces(path) if decoded else None
        for batch in rows_of(batches, 1024):
            keys, bodies, found = [], [], []
            for row, (key, raw) in enumerate(zip(batch.column("digest").to_pylist(), batch.column("packed").to_pylist(), strict=True)):
                if key != before:  # copies of a text follow each other
                    keys.append(key)
                    bodies.append(unpacked(raw, loosen)[0])
                    found.append(batch.column("found")[row].as_py() or ())
                before = key
                if bodies and (sum(map(len, bodies[-256:])) > TOKENS or len(bodies) >= 256):
                    yield _texts(keys, _filled(bodies, found, known.value), pieces)
                    keys, bodies, found = [], [], []
            if bodies:
                yield _texts(keys, _filled(bodies, found, known.value), pieces)

    # Both uses take whole rows of the exchanged texts, so that they read one exchange.
    texts = docs.select(F.col(text).alias("text")).mapInArrow(split, "digest binary, packed binary").repartition("digest")
    rare = texts.mapInArrow(rare_words, "digest binary, word string, gaps binary")
    met = rare.join(table.select("word", "ids").hint("merge"), "word").groupBy("digest").agg(F.collect_set(F.struct("gaps", "ids")).alias("found"))
    whole = texts.join(met.hint("merge"), "digest", "left").sortWithinPartitions("digest")
    return whole.select("digest", "packed", "found").mapInArrow(filled, "digest binary, ids binary" + (", decoded string" if decoded else ""))


def _filled(bodies: list[bytes], found: list, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts, one after the other, from the numbers of their words and the ids of the words in their gaps; and bounds."""
    number, bounds = _numbers(bodies)
    each, start = known.sizes[number], known.starts[number]
    gaps = np.flatnonzero(number == 0)
    first = np.searchsorted(gaps, bounds[:-1]).tolist()
    flats, count, place = [], 0, []
    for k, some in enumerate(found):
        for one in some:
            ids = np.frombuffer(one["ids"], known.width)
            some_gaps = np.frombuffer(one["gaps"], np.uint8) if one["gaps"].isascii() else _numbers([one["gaps"]])[0]
            at = gaps[first[k] + some_gaps.astype(np.int64)]
            each[at] = len(ids)
            start[at] = count  # in the ids of gaps
            count += len(ids)
            flats.append(ids)
            place.append(at)
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    begin = ends - each
    source = np.repeat(start - begin, each) + np.arange(total)
    if place:
        at = np.sort(np.concatenate(place))
        size = each[at]
        inside = np.repeat(begin[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own = source[inside]
        source[inside] = 0
    ids = known.flat[source] if len(known.flat) else np.zeros(total, known.width)
    if place:
        ids[inside] = np.concatenate(flats)[own]
    return ids.astype("<u4"), np.concatenate(([0], ends))[bounds]


class Pieces:
    """The pieces of a vocabulary by id, and how its tokenizer puts them together."""

    def __init__(self, path: str):
        self.tokenizer = loaded(path, True).tokenizer
        names = [self.tokenizer.id_to_token(i) for i in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)]
        self.names = pa.array(names, pa.large_string())
        self.there = pc.is_valid(self.names).to_numpy(zero_copy_only=False)
        self.whole = bool(self.there.all())

    def text(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The text of each part of the ids: every id is joined to its piece; ids outside the vocabulary are skipped."""
        if len(ids) and (not self.whole or int(ids.max()) >= len(self.names)):
            kept = ids < len(self.names)
            kept[kept] = self.there[ids[kept]]
            bounds = np.concatenate(([0], np.cumsum(kept)))[bounds]
            ids = ids[kept]
        joined = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), self.names.take(pa.array(ids)))
        if self.tokenizer.decoder is None:
            return pc.binary_join(joined, pa.scalar(" ", pa.large_string())).cast(pa.string())
        back = {ord(c): b for b, c in byte_alphabet().items()}
        texts = pc.binary_join(joined, pa.scalar("", pa.large_string())).to_pylist()
        return pa.array([t.translate(back).encode("latin-1").decode("utf-8", "replace") for t in texts], pa.string())


def _texts(keys: list[bytes], filled: tuple[np.ndarray, np.ndarray], pieces: Pieces | None) -> pa.RecordBatch:
    ids, bounds = filled
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(bounds.astype(np.int64) * 4), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
    columns = [pa.array(keys, pa.binary()), raw.cast(pa.binary())]
    if pieces is None:
        return pa.record_batch(columns, ["digest", "ids"])
    return pa.record_batch([*columns, pieces.text(ids, bounds)], ["digest", "ids", "decoded"])


def encode(docs: DataFrame, path: str, words: bool = True, doc_id: str = "doc_id", text: str = "text", hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Ids of every text under the tokenizer file ``path``: (doc_id, ids), ids as little-endian unsigned 32-bit integers.

    ``words`` says that the file lower-cases and drops white space; else it is a byte-level one. One result row per input
    row, repeated rows and repeated or null ids included; null text counts as empty (no ids); special strings inside a text
    are one id each. A long text is cut at white space, so a task holds about a million code points of it as numbers, and
    the text and its ids once; only a word without white space is held whole. Further columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    return per_document(docs, encoded_texts(docs, path, words, text, hot_bytes), doc_id, text)


def per_document(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What was found for each text (by ``digest``), with the doc_id of every row that holds it."""
    rows = docs.select(F.col(doc_id).alias("_doc_id"), digest(F.col(text)).alias("digest"))
    return rows.join(found, "digest").drop("digest").withColumnRenamed("_doc_id", doc_id)


def decode(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text that the ids (as ``encode`` gives them) decode to, special strings included.

    Every id is joined to its piece; the pieces are the vocabulary, which a worker reads from the file, so the join needs no
    shuffle. Null ids decode to null, no ids to the empty text; an id outside the vocabulary is skipped, as the library does.
    A column named ``decoded`` is replaced.
    """
    rest = [f for f in encoded.schema.fields if f.name != decoded]

    def joined(batches):
        pieces = Pieces(path)
        for batch in rows_of(batches, 256):
            texts: list[str | None] = []
            parts, bounds = [], [0]
            for raw in (batch.column(ids)[k].as_buffer() for k in range(batch.num_rows)):
                parts.append(np.frombuffer(raw, "<u4") if raw is not None else np.zeros(0, "<u4"))
                bounds.append(bounds[-1] + len(parts[-1]))
                if bounds[-1] > TOKENS:
                    texts += pieces.text(np.concatenate(parts), np.array(bounds)).to_pylist()
                    parts, bounds = [], [0]
            if parts:
                texts += pieces.text(np.concatenate(parts), np.array(bounds)).to_pylist()
            null = pc.is_null(batch.column(ids)).to_pylist()
            found = pa.array([None if n else t for n, t in zip(null, texts, strict=True)], pa.string())
            yield pa.record_batch([batch.column(f.name) for f in rest] + [found], [f.name for f in rest] + [decoded])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return encoded.select(*[f"`{f.name}`" for f in rest]).mapInArrow(joined, f"{fields}, `{decoded}` string")

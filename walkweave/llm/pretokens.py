"""Pre-tokens of whole texts, cut with numpy over code points, and the pieces the library makes of each.

Character classes come from the tokenizer's own pre-tokenizer, asked once per code point, so the cuts agree with the
library on every character. Ids and counts of a pre-token come from the library's model, once per distinct pre-token
that a worker meets (its memo is emptied when it reaches ``MEMO`` entries, so memory is bounded).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

SPACE, BLANK, LETTER, DIGIT, OTHER, STOP = range(6)
#: Entries of a worker's memo of pre-tokens.
MEMO = 400_000
#: Code points cut at once.
CHUNK = 1_500_000
APOSTROPHE = 39


def byte_alphabet() -> dict[int, str]:
    """Byte -> character of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in kept)
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pretokens:
    """Cuts texts as the tokenizer file ``path`` does: byte-level words with their leading space, or lower-cased words
    without white space (``words=True``)."""

    def __init__(self, path: str, words: bool = False):
        from tokenizers import Tokenizer

        self.words = words
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.model, self.cutter, self.normalizer = self.tokenizer.model, self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        self.classes = np.full(0x110000, 255, np.uint8)
        self.lowered: dict[str, bool] = {}
        self.alphabet = byte_alphabet()
        self.ids: dict[str, bytes] = {}

    def _class(self, c: str) -> int:
        """How the library sees one character: by what it joins with."""
        if c == " ":
            return SPACE
        if c == "'":
            return OTHER
        if len(self.cutter.pre_tokenize_str(f"a{c}b")) == 1:
            return LETTER
        if len(self.cutter.pre_tokenize_str(f"!{c}!")) == 1:
            return OTHER
        if self.words:
            return BLANK if len(self.cutter.pre_tokenize_str(f"!{c}!")) == 2 else DIGIT
        return DIGIT if len(self.cutter.pre_tokenize_str(f"1{c}1")) == 1 else BLANK

    def classify(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        if (found == 255).any():
            for p in np.unique(points[found == 255]):
                self.classes[p] = self._class(chr(p)) if not 0xD800 <= p < 0xE000 else OTHER
            found = self.classes[points]
        return found

    def normal(self, text: str) -> str:
        """The library's normal form; Python's own where it is proven equal character by character."""
        if not self.words:
            return text
        if text.isascii():
            return text.lower()
        if "Σ" in text or not unicodedata.is_normalized("NFC", text):
            return self.normalizer.normalize_str(text)
        for c in set(text):
            if c not in self.lowered:
                self.lowered[c] = c.isspace() or self.normalizer.normalize_str(c) == c.lower()
            if not self.lowered[c]:
                return self.normalizer.normalize_str(text)
        return text.lower()

    def segments(self, text: str) -> tuple[list[str], list[int]]:
        """Parts between special strings, in normal form, and the ids of the special strings."""
        if not any(s in text for s in self.specials):
            return [self.normal(text)], []
        parts, ids = [text], []
        for s, i in self.specials.items():
            cut = [p.split(s) for p in parts]
            ids += [i] * sum(len(c) - 1 for c in cut)
            parts = [x for c in cut for x in c]
        return [self.normal(p) for p in parts], ids

    def starts(self, points: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin; a STOP after every text."""
        before = np.concatenate(([STOP], cls[:-1]))
        after = np.concatenate((cls[1:], [STOP]))
        blank, blank_before = cls <= BLANK, before <= BLANK
        start = (cls != before) & ~blank & (cls != STOP)
        if self.words:
            start |= cls == DIGIT
        else:
            # A white-space run: its last character stands alone before text, or leads it if it is a space.
            last = blank & (after > BLANK) & (after != STOP)
            start |= (blank & ~blank_before) | last
            start &= ~((before == SPACE) & ~blank)
        at = np.flatnonzero((points == APOSTROPHE) & start)
        if at.size:
            padded = np.concatenate((points, np.zeros(3, points.dtype)))
            one, two = padded[at + 1], padded[at + 2]
            size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
            for a, b in ("re", "ve", "ll"):
                size[(one == ord(a)) & (two == ord(b))] = 3
            at, size = at[size > 0], size[size > 0]
            start[at + 1] = False
            end = at + size
            start[end[cls[np.minimum(end, len(cls) - 1)] == LETTER]] = True
        return start

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pre-tokens of the texts, the number (in that list) of each pre-token in order, and how many each text has.

        Equal pre-tokens are found by two 64-bit hashes of their code points, so only distinct ones become strings.
        """
        if not texts:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = "\x00".join(texts) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        cls = self.classify(points)
        cls[stops] = STOP
        start = self.starts(points, cls)
        begin = np.flatnonzero(start)
        if not begin.size:
            return [], begin, np.zeros(len(texts), np.int64)
        outside = cls == STOP
        if self.words:
            outside |= cls <= BLANK
        bound = np.flatnonzero(start | outside)
        end = bound[np.searchsorted(bound, begin, "right")]
        place = np.arange(begin[0], len(points)) - np.repeat(begin, np.diff(begin, append=len(points)))
        shown = points[begin[0]:].astype(np.uint64) + np.uint64(1)
        shown[outside[begin[0]:]] = 0
        one, two = (np.add.reduceat(shown * w[place], begin - begin[0]) for w in weights(int(place.max()) + 1))
        order = np.argsort(one)
        fresh = np.concatenate(([True], one[order[1:]] != one[order[:-1]]))
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        if (two != two[first][number]).any():  # a collision of the first hash: compare the strings themselves
            seen: dict[str, int] = {}
            words = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            number = np.array([seen.setdefault(w, len(seen)) for w in words])
            distinct = list(seen)
        else:
            distinct = [joined[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        return distinct, number, np.diff(np.searchsorted(begin, stops), prepend=0)

    def pieces(self, pretoken: str) -> list[int]:
        """Ids of one pre-token in normal form, as the model gives them."""
        mapped = pretoken.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(mapped)]

    def packed(self, pretokens: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each pre-token."""
        memo = self.ids
        if len(memo) > MEMO:
            memo.clear()
        for w in pretokens:
            if w not in memo:
                memo[w] = np.array(self.pieces(w), "<u4").tobytes()
        return [memo[w] for w in pretokens]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        distinct, number, counts = self.cut(texts)
        if not distinct:
            return [np.zeros(0, "<u4") for _ in texts]
        known = self.packed(distinct)
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        offsets = np.cumsum(sizes) - sizes
        each = sizes[number]
        ends = np.cumsum(each)
        ids = flat[np.repeat(offsets[number] - (ends - each), each) + np.arange(ends[-1])]
        upto = np.concatenate(([0], ends))[np.cumsum(counts)]
        return np.split(ids, upto[:-1])

    def encode(self, texts: list[str]):
        """Ids of each text as little-endian 32-bit arrays, in order; texts are cut in runs of about CHUNK code points."""
        for run in runs(texts):
            odd = [any(s in t for s in self.specials) for t in run]
            plain = iter(self._ids([self.normal(t) for t, o in zip(run, odd, strict=True) if not o]))
            for t, o in zip(run, odd, strict=True):
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4") if o else next(plain)


def runs(texts: list[str]):
    """Runs of texts of about CHUNK code points each."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def within(text: str, size: int = CHUNK):
    """A text (in normal form) in parts of about ``size`` code points, cut where no pre-token reaches across: at a space
    between two characters that are not white space. Without such a place it stays whole."""
    at = 0
    while len(text) - at > size:
        cut = _SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start() + 1]
        at = cut.start() + 1
    yield text[at:] if at else text


_SPACE = re.compile(r"[^\s\x1c-\x1f\x85](?= [^\s\x1c-\x1f\x85])")
_WEIGHTS: list[np.ndarray] = []


def weights(n: int) -> list[np.ndarray]:
    """Two sequences of odd 64-bit numbers of at least ``n`` terms, equal in every process."""
    if not _WEIGHTS or len(_WEIGHTS[0]) < n:
        k = np.arange(max(256, 2 * n), dtype=np.uint64)
        _WEIGHTS[:] = []
        for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
            x = (k + np.uint64(1)) * np.uint64(salt)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            _WEIGHTS.append((x ^ (x >> np.uint64(31))) | np.uint64(1))
    return _WEIGHTS


_LOADED: dict[tuple[str, bool], Pretokens] = {}


def loaded(path: str, words: bool = False) -> Pretokens:
    """One instance per worker process; the library's own threads stay off as Spark deals the work out."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, words) not in _LOADED:
        _LOADED[path, words] = Pretokens(path, words)
    return _LOADED[path, words]

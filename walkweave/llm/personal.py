"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

#: The base kinds in their order, with their patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its start fails at every later place of it, so only starts of runs are tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
#: All kinds, in the order of a result.
KINDS = (*BASE, "name", "secret", "ssn")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Candidates beside the base: written-out addresses, national phone numbers, credentials, social security numbers, names.
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+")
NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?i:token|secret|password|api[_-]?key)\s*[=:]\s*[\"']?([0-9A-Za-z+/_-]{16,})")
#: Gazetteers, fixed values: common given names, top-level domains, telephone country codes, first digits of cards.
GIVEN = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Mary", "Patricia", "Jennifer", "Linda",
         "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Maria", "Peter", "Paul", "Daniel", "Laura", "Emma", "Julia", "Martin", "Hans", "Pierre", "Carlos")
NAME = re.compile(r"\b(?:%s) [A-Z][a-z]{2,}\b" % "|".join(GIVEN))
DOMAINS = frozenset("com org net edu gov mil info biz io co de fr es uk us eu it nl ch at be ca au jp cn br in ru se no pl pt".split())
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "61", "62",
             "64", "65", "66", "81", "82", "86", "90", "91", "351", "353", "358", "420")
CARDS = "3456"
#: Words before a span that speak for its kind, and words that speak against any.
CUES = {"email": ("mail", "contact", "write", "reach"), "ip": ("ip", "address", "host", "server", "login"), "card": ("card", "visa", "credit", "payment"),
        "phone": ("phone", "tel", "call", "fax", "mobile"), "name": ("name", "mr", "mrs", "dear", "contact", "by"), "secret": ("token", "secret", "password", "key"),
        "ssn": ("ssn", "social", "security")}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "build", "commit", "checksum")
LABELERS = ("pattern", "gazetteer", "context", "border", "variety")
BEFORE = 40


def luhn(digits: str) -> bool:
    doubled = (int(d) * (1 + (k % 2)) for k, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping places of EMAIL, found from each @ so that other words are not tried."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, each kind leftmost and non-overlapping; matches that fail their test are dropped."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def more_candidates(text: str):
    """Spans beside the base that the classifier judges."""
    if " at " in text or "(at)" in text or "[at]" in text:
        for m in SPELLED.finditer(text) if "dot" in text else ():
            yield ("email", *m.span())
    for m in NATIONAL.finditer(text):
        yield ("phone", *m.span())
    for m in SSN.finditer(text):
        yield ("ssn", *m.span())
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            yield ("secret", *m.span(1))
    for m in NAME.finditer(text):
        yield ("name", *m.span())


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote per labeler: 1 personal data, -1 not, 0 no opinion."""
    span = text[start:end]
    digits = [c for c in span if c.isdigit()]
    before = text[max(0, start - BEFORE):start].lower()
    words = re.findall(r"[a-z]+", before)[-5:]
    if kind == "email":
        gazetteer = 1 if re.split(r"[.\s)\]]+", span.lower())[-1] in DOMAINS else -1
        pattern = 1 if base or "dot" in span else 0
    elif kind == "ip":
        parts = span.split(".")
        gazetteer = -1 if parts[0] in ("0", "10", "127") or span.startswith("192.168.") else 0
        pattern = 1 if all(len(p) == 1 or p[0] != "0" for p in parts) else -1
    elif kind == "card":
        gazetteer, pattern = (1 if digits[0] in CARDS else -1), 1
    elif kind == "phone":
        number = "".join(digits)
        gazetteer = (1 if number.startswith(COUNTRIES) else -1) if span[0] == "+" else 0
        pattern = 1 if base and 10 <= len(digits) <= 13 else 1 if not base else 0
    elif kind == "ssn":
        gazetteer = -1 if span[:3] in ("000", "666") or span[0] == "9" else 0
        pattern = 1
    elif kind == "secret":
        gazetteer, pattern = 0, 1 if digits else 0
    else:
        gazetteer, pattern = 1, 0
    context = 1 if any(w.startswith(c) for w in words for c in CUES[kind]) else -1 if any(w in AGAINST for w in words) else 0
    border = 1 if (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum()) else -1
    variety = 0 if kind in ("email", "name") else 1 if len(set(digits)) >= 4 else -1
    return pattern, gazetteer, context, border, variety


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier: one per kind, one per labeler and vote; and the labelers' estimated reliabilities."""

    kind: dict[str, float]
    vote: tuple[tuple[float, float, float], ...]
    reliability: tuple[float, ...]

    def score(self, kind: str, cast: tuple[int, ...]) -> float:
        z = self.kind[kind] + sum(w[v + 1] for w, v in zip(self.vote, cast, strict=True))
        return float(1 / (1 + np.exp(-z)))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> SpanModel:
    """EM over vote patterns (kind, votes, number of spans), then a logistic span classifier on the posteriors.

    EM takes the labelers as independent given the truth, each right with its own probability whenever it votes, and a
    prior for each kind. The classifier is fitted to the posteriors, weighted by the spans, with a ridge of one span.
    """
    kinds = sorted({k for k, _, _ in patterns})
    v = np.array([p[1] for p in patterns], float).reshape(len(patterns), len(LABELERS))
    n = np.array([p[2] for p in patterns], float)
    which = np.array([kinds.index(p[0]) for p in patterns], int)
    right, prior = np.full(len(LABELERS), 0.8), np.full(len(kinds), 0.6)
    post = np.zeros(len(n))
    for _ in range(rounds):
        z = np.log(prior / (1 - prior))[which] + v @ np.log(right / (1 - right))
        post = 1 / (1 + np.exp(-z))
        # One span of doubt on either side keeps every estimate inside (0, 1); a labeler is taken as better than chance.
        agree = ((v == 1) * (n * post)[:, None] + (v == -1) * (n * (1 - post))[:, None]).sum(0)
        right = np.clip((agree + 1.6) / (((v != 0) * n[:, None]).sum(0) + 2), 0.51, 0.999)
        prior = np.clip((np.bincount(which, n * post, len(kinds)) + 1.2) / (np.bincount(which, n, len(kinds)) + 2), 0.001, 0.999)
    x = np.concatenate([which[:, None] == np.arange(len(kinds)), *[(v[:, [k]] == np.array([-1, 0, 1])) for k in range(len(LABELERS))]], axis=1).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (n * (post - p)) - w)
    each = w[len(kinds):].reshape(len(LABELERS), 3)
    return SpanModel({k: float(w[kinds.index(k)]) if k in kinds else 0.0 for k in KINDS}, tuple(tuple(map(float, r)) for r in each), tuple(map(float, right)))


def vote_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, votes, n): how often each pattern of votes is cast on a candidate span, over all texts."""

    def run(batches):
        sums: Counter = Counter()
        for batch in rows_of(batches):
            for t in batch.column("text").to_pylist():
                if t:
                    base = base_spans(t)
                    sums.update((k, ",".join(map(str, votes(t, k, a, b, True)))) for k, a, b in base)
                    sums.update((k, ",".join(map(str, votes(t, k, a, b, False)))) for k, a, b in more_candidates(t))
        if sums:
            yield pa.record_batch([pa.array([k for k, _ in sums]), pa.array([v for _, v in sums]), pa.array(sums.values(), pa.int64())], ["kind", "votes", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "kind string, votes string, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """The model of a corpus, from the votes on all its candidates: at most one row per kind and pattern reaches the driver."""
    rows = vote_patterns(docs, text).orderBy("kind", "votes").collect()
    return estimate([(r["kind"], tuple(map(int, r["votes"].split(","))), r["n"]) for r in rows])


def all_spans(text: str, model: SpanModel, accept: float = 0.5) -> list[tuple[str, int, int, float, bool]]:
    """Base spans, and candidates of score ``accept`` or more that touch no span taken before them."""
    base = base_spans(text)
    out = [(k, a, b, model.score(k, votes(text, k, a, b, True)), True) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    upto = 0  # end of the candidates taken so far, which come by their starts
    for k, a, b in sorted(more_candidates(text), key=lambda x: (x[1], -x[2], x[0])):
        before = bisect_left(starts, b)
        if a < upto or before and ends[before - 1] > a:
            continue
        score = model.score(k, votes(text, k, a, b, False))
        if score >= accept:
            out.append((k, a, b, score, False))
            upto = b
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double, base: boolean>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def find_spans(docs: DataFrame, model: SpanModel, text: str = "text", redact: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``spans`` (kind, start, end in code points, score, base), by kind and start.

    Base spans are always there; the model adds others. With ``redact`` every span of the text is replaced by its kind
    in brackets (the union of overlapping spans by the kind that begins first). Null and empty texts have no spans and
    stay as they are; repeated rows stay; an empty table gives an empty result. A column named spans is replaced.
    """
    own = [c for c in docs.columns if c != "spans"]
    row = docs.select(*own).schema
    names = row.names

    def run(batches):
        for batch in rows_of(batches):
            texts = batch.column(names.index(text)).to_pylist()
            found = [all_spans(t, model) if t else [] for t in texts]
            columns = list(batch.columns)
            if redact:
                at = names.index(text)
                columns[at] = pa.array([redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string())
            spans = pa.array([[dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in f] for f in found], ARROW)
            yield pa.record_batch([*columns, spans], [*names, "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in row) + f", spans {SPANS}"
    return docs.select(*own).mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple]) -> str:
    out, at = [], 0
    for kind, a, b, _, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])

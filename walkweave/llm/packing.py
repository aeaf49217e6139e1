"""Hierarchical packing of documents into windows of several context sizes."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, rows_of, texts_of
from .pretokens import loaded

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class Packer:
    """Packs pieces of documents into windows of ``tiers`` (powers of two, ascending) tokens.

    Whole windows of the largest size leave at once. What remains of each document goes to the smallest tier that holds
    it. Windows are closed from the largest tier down: the tier's longest piece opens one, the largest whole pieces of
    shorter tiers fill its gap, and a last piece is cut to fill it exactly. One open window at most outlives a block; at
    the end it is divided into windows of powers of two, so no window is padded.
    """

    def __init__(self, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.top, self.step_tokens = tiers, tiers[-1], step_tokens
        self.pools: dict[int, list] = {t: [] for t in tiers}
        self.closed: list[tuple[int, list]] = []
        self.serial = 0

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.top
        for at in range(0, whole, self.top):
            self.closed.append((self.top, [self.piece(doc, at, ids[at:at + self.top])]))
        if whole < len(ids):
            self.route((doc, whole, ids[whole:].copy()))

    @staticmethod
    def piece(doc, start: int, ids: np.ndarray) -> tuple:
        return doc, start, len(ids), zlib.crc32(ids.tobytes())

    def route(self, item) -> None:
        self.serial += 1
        insort(self.pools[next(t for t in self.tiers if t >= len(item[2]))], (len(item[2]), self.serial, item))

    def filler(self, gap: int, below: int):
        """The largest whole piece that fits, from the longest tier on; else one to be cut, the shortest first."""
        for t in reversed(self.tiers):
            if t <= below and self.pools[t] and (k := bisect_right(self.pools[t], (gap, float("inf")))):
                return self.pools[t].pop(k - 1)[2]
        for t in self.tiers:
            if t <= below and self.pools[t]:
                return self.pools[t].pop(0)[2]
        return None

    def pack(self) -> None:
        """Closes every window that the pools can fill; an unfinished one goes back to them."""
        for tier in reversed(self.tiers):
            while self.pools[tier]:
                window = [self.pools[tier].pop()[2]]
                gap = tier - len(window[0][2])
                while gap:
                    item = self.filler(gap, tier)
                    if item is None:
                        break
                    doc, start, ids = item
                    if len(ids) > gap:
                        self.route((doc, start + gap, ids[gap:]))
                        ids = ids[:gap]
                    window.append((doc, start, ids))
                    gap -= len(ids)
                if gap:
                    for item in window:
                        self.route(item)
                    return
                self.closed.append((tier, [self.piece(*x) for x in window]))

    def finish(self) -> None:
        """Divides what is left into windows of powers of two."""
        rest = [x[2] for t in self.tiers for x in self.pools[t]]
        for t in self.tiers:
            self.pools[t].clear()
        left = sum(len(x[2]) for x in rest)
        while left:
            size = min(self.top, 1 << (left.bit_length() - 1))
            window, gap = [], size
            while gap:
                doc, start, ids = rest.pop()
                if len(ids) > gap:
                    rest.append((doc, start + gap, ids[gap:]))
                    ids = ids[:gap]
                window.append(self.piece(doc, start, ids))
                gap -= len(ids)
            self.closed.append((size, window))
            left -= size

    def groups(self):
        """Closed windows dealt to step groups of about ``step_tokens``, the largest first to the lightest group."""
        total = sum(size for size, _ in self.closed)
        loads = [(0, g) for g in range(max(1, round(total / self.step_tokens)))]
        for size, window in sorted(self.closed, key=lambda x: -x[0]):
            load, g = heapq.heappop(loads)
            heapq.heappush(loads, (load + size, g))
            yield g, size, window
        self.closed = []


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = (64, 128, 256, 512, 1024), end_id: int = 0, step_tokens: int = 65_536,
         block: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A document is the ids of its text and ``end_id``; every id lies in one piece. Partitions are packed by themselves,
    ``block`` documents at a time, so nothing is shuffled and a task holds the short rests of a block only. All windows
    end full, or at a power of two at the end of a partition: where documents are cut, and into how many pieces, depends on
    the partitions; that pieces cover each document once does not. Further columns are ignored, whatever their names. Null and empty texts are the end id alone; repeated rows
    and repeated or null ids are documents of their own; an empty table gives an empty result.
    """

    def run(batches):
        tool = loaded(path)
        part, windows, steps = TaskContext.get().partitionId(), 0, 0
        packer = Packer(tiers, step_tokens)

        def flush():
            nonlocal windows, steps
            rows, most = [], -1
            for g, size, window in packer.groups():
                at = 0
                for (doc, tokens), start, length, crc in window:
                    rows.append((doc, start, length, crc, tokens, row_key(part, windows), at, size, row_key(part, steps + g)))
                    at += length
                windows += 1
                most = max(most, g)
            steps += most + 1
            for k in range(0, len(rows), 10_000):
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[k:k + 10_000], strict=True)], SCHEMA.replace(" long", "").split(", "))

        held = 0
        end = np.array([end_id], "<u4")
        for batch in rows_of(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tool.encode(texts_of(batch)), strict=True):
                ids = np.concatenate((ids, end))
                packer.add((doc, len(ids)), ids)
            held += batch.num_rows
            if held >= block:
                held = 0
                packer.pack()
                yield from flush()
        packer.pack()
        packer.finish()
        yield from flush()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)

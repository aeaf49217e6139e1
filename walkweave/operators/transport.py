"""Alignment of many walk pairs at once, and least-cost matching of walks with multiplicities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of the alignment tables that are held at once.
CELLS = 1 << 20


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.values.to_numpy(zero_copy_only=False), whole.offsets.to_numpy()


def _padded(values: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(first), width), values.dtype)
    row = np.repeat(np.arange(len(first)), size)
    col = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[row, col] = values[np.repeat(first, size) + col]
    return out


def common_weights(x, w, y, strands: bool = True) -> np.ndarray:
    """Weight of the heaviest common subsequence of the walks in each row of three list columns (``w`` weighs ``x``).

    With ``strands`` the better of ``y`` and its reverse complement counts. Rows of like size share a block of at most
    ``CELLS`` cells; within a block all rows advance together.
    """
    xv, xo = _lists(x)
    wv, _ = _lists(w)
    yv, yo = _lists(y)
    nx, ny = np.diff(xo), np.diff(yo)
    order = np.lexsort((ny, nx))
    out = np.zeros(len(nx))
    at = 0
    while at < len(order):
        # rows are in order of their first length; the widest second length so far bounds the block
        wide = np.maximum.accumulate(ny[order[at:at + CELLS]]) + 1
        fits = np.arange(1, len(wide) + 1) * wide * (2 if strands else 1) <= CELLS
        end = at + max(1, int(fits.argmin()) if not fits.all() else len(fits))
        block = order[at:end]
        rows, cols = int(nx[block].max()), int(ny[block].max())
        xs, ws = _padded(xv, xo[block], nx[block], rows), _padded(wv.astype(float), xo[block], nx[block], rows)
        ys = _padded(yv, yo[block], ny[block], cols)
        if strands:
            back = _padded(-yv[::-1], len(yv) - yo[block + 1], ny[block], cols)
            xs, ws, ys = np.concatenate((xs, xs)), np.concatenate((ws, ws)), np.concatenate((ys, back))
        best = np.zeros((len(ys), cols + 1))
        for i in range(rows):
            hit = (ys == xs[:, i:i + 1]) & (ys != 0)
            best[:, 1:] = np.maximum(best[:, 1:], best[:, :-1] + np.where(hit, ws[:, i:i + 1], 0.0))
            np.maximum.accumulate(best, axis=1, out=best)
        last = best[:, -1]
        out[block] = np.maximum(last[:len(block)], last[len(block):]) if strands else last
        at = end
    return out


def transport(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Flow of least cost that ships every supply to the demands (equal sums), by shortest augmenting paths.

    Rows and columns are distinct walks, their numbers only bound the flow, so the work does not grow with multiplicities.
    """
    n, k = cost.shape
    flow = np.zeros((n, k), np.int64)
    left, need = supply.astype(np.int64).copy(), demand.astype(np.int64).copy()
    u, v = np.zeros(n, cost.dtype), np.zeros(k, cost.dtype)
    far = np.iinfo(np.int64).max if cost.dtype.kind == "i" else np.inf
    for source in range(n):
        while left[source]:
            dist = cost[source] - u[source] - v
            via = np.full(k, source)
            done = np.zeros(k, bool)
            row_at = {source: dist.dtype.type(0)}
            row_via: dict[int, int] = {}
            while True:
                col = int(np.where(done, far, dist).argmin())
                done[col] = True
                if need[col]:
                    break
                for row in np.flatnonzero(flow[:, col]).tolist():
                    if row in row_at:
                        continue
                    row_at[row], row_via[row] = dist[col], col
                    step = dist[col] + cost[row] - u[row] - v
                    better = ~done & (step < dist)
                    dist[better], via[better] = step[better], row
            reach = dist[col]
            for row, d in row_at.items():
                u[row] += reach - d
            v[done] -= reach - dist[done]
            path, amount, c = [], min(left[source], need[col]), col
            while True:
                row = int(via[c])
                path.append((row, c))
                if row == source:
                    break
                c = row_via[row]
                amount = min(amount, flow[row, c])
                path.append((row, c))
            for step, (row, c) in enumerate(path):
                flow[row, c] += amount if step % 2 == 0 else -amount
            left[source] -= amount
            need[col] -= amount
    return flow


def matched_cost(a: list, b: list, prices: dict, thresh: float) -> float:
    """Cost of matching walks ``(key, weight, copies)`` of two sides; what has no partner costs its own weight.

    Costs up to ``thresh`` do not count. Of the cheapest matchings the one that counts least is taken (with whole costs).
    """
    na, nb = sum(x[2] for x in a), sum(x[2] for x in b)
    if not na and not nb:
        return 0.0
    cost = np.array([[prices[x[0], y[0]] for y in b] for x in a], float).reshape(len(a), len(b))
    supply, demand = [x[2] for x in a], [y[2] for y in b]
    if na < nb:
        cost = np.vstack([cost, [[y[1] for y in b]]])
        supply.append(nb - na)
    elif nb < na:
        cost = np.hstack([cost, [[x[1]] for x in a]])
        demand.append(na - nb)
    counted = np.where(cost > thresh, cost, 0.0)
    used = cost
    top = float(np.abs(cost).sum()) * max(na, nb)
    if thresh > 0 and (cost == np.floor(cost)).all() and cost.max() * (top + 1) * 4 < 2**62:
        used = cost.astype(np.int64) * int(top + 1) + counted.astype(np.int64)
    return float((transport(used, np.array(supply), np.array(demand)) * counted).sum())


def aligned(pairs: DataFrame, strands: bool = True) -> DataFrame:
    """Adds ``common`` to rows with walks ``x`` (weights ``w``) and ``y``, and drops the walks."""
    kept = [f for f in pairs.schema.fields if f.name not in ("x", "w", "y")]

    def run(batches):
        for batch in batches:
            common = common_weights(batch.column("x"), batch.column("w"), batch.column("y"), strands)
            yield pa.record_batch([batch.column(f.name) for f in kept] + [pa.array(common)], [f.name for f in kept] + ["common"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return pairs.mapInArrow(run, f"{fields}, common double")


def matchings(packed: DataFrame, thresh: float) -> DataFrame:
    """``(pair_id, edit)`` of rows (pair_id, a, b, cells): both sides' walks (key, weight, copies), and cells (i, j, cost)."""

    def run(batches):
        for batch in batches:
            out = []
            for a, b, cells in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "cells")), strict=True):
                side = lambda rows: sorted((tuple(r["key"].values()), r["weight"], r["copies"]) for r in rows or [])
                prices = {}
                for c in cells or []:
                    i, j = (tuple(c[e].values()) for e in "ij")
                    prices[i, j] = prices[j, i] = c["cost"]
                out.append(matched_cost(side(a), side(b), prices, thresh))
            yield pa.record_batch([batch.column("pair_id"), pa.array(out, pa.float64())], ["pair_id", "edit"])

    return packed.mapInArrow(run, "pair_id long, edit double")

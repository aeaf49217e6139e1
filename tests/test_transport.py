"""Alignment of many pairs and matching with multiplicities against plain definitions."""

import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from walkweave.operators import distance as D
from walkweave.operators import transport as TR


def lcs(x, w, y):
    best = [0.0] * (len(y) + 1)
    for a, v in zip(x, w):
        row = [0.0]
        for j, b in enumerate(y):
            row.append(max(row[j], best[j + 1], best[j] + (v if a == b else 0)))
        best = row
    return best[-1]


def test_common_weights():
    rng = np.random.default_rng(1)
    xs = [rng.integers(1, 5, rng.integers(0, 12)) * rng.choice([-1, 1]) for _ in range(300)]
    ys = [rng.integers(1, 5, rng.integers(0, 12)) for _ in range(300)]
    ws = [np.abs(x) * 2.0 for x in xs]
    column = lambda rows, kind: pa.array([r.tolist() for r in rows], pa.list_(kind))
    args = column(xs, pa.int32()), column(ws, pa.float64()), column(ys, pa.int32())
    one, two = TR.common_weights(*args, strands=False), TR.common_weights(*args)
    for k in range(300):
        x, w, y = xs[k].tolist(), ws[k].tolist(), ys[k].tolist()
        assert one[k] == lcs(x, w, y) and two[k] == max(lcs(x, w, y), lcs(x, w, [-v for v in reversed(y)]))
    part = TR.common_weights(*[a.slice(100, 50) for a in args])
    assert part.tolist() == two[100:150].tolist()


def test_blocks_are_bounded(monkeypatch):
    rng = np.random.default_rng(2)
    rows = [rng.integers(1, 9, n).tolist() for n in (1, 50, 3, 200, 7, 120)]
    column = pa.array(rows, pa.list_(pa.int32()))
    weights = pa.array([[1.0] * len(r) for r in rows], pa.list_(pa.float64()))
    whole = TR.common_weights(column, weights, column)
    monkeypatch.setattr(TR, "CELLS", 64)
    assert TR.common_weights(column, weights, column).tolist() == whole.tolist() == [float(len(r)) for r in rows]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=4), st.lists(st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 10**6), st.sampled_from([0, 4]))
def test_matching_with_copies(a, b, seed, thresh):
    rng = np.random.default_rng(seed)
    left = [((i,), float(rng.integers(5, 12)), c) for i, c in enumerate(a)]
    right = [((10 + j,), float(rng.integers(5, 12)), c) for j, c in enumerate(b)]
    prices = {(x[0], y[0]): float(rng.integers(0, 9)) for x in left for y in right}
    rows, cols = [x for x in left for _ in range(x[2])], [y for y in right for _ in range(y[2])]
    n = max(len(rows), len(cols))
    if n > 7:
        return
    cost = lambda i, j: prices[rows[i][0], cols[j][0]] if i < len(rows) and j < len(cols) else rows[i][1] if i < len(rows) else cols[j][1]
    totals = []
    for p in permutations(range(n)):
        each = [cost(i, p[i]) for i in range(n)]
        totals.append((sum(each), sum(c for c in each if c > thresh)))
    assert TR.matched_cost(left, right, prices, thresh) == min(totals)[1]


def test_work_does_not_grow_with_copies():
    prices = {(("a",), ("x",)): 3.0, (("a",), ("y",)): 1.0, (("b",), ("x",)): 1.0, (("b",), ("y",)): 9.0}
    many = 10**9
    got = TR.matched_cost([(("a",), 50.0, many), (("b",), 50.0, 7)], [(("x",), 50.0, many), (("y",), 50.0, 7)], prices, 0)
    assert math.isclose(got, 7 + 7 + 3 * (many - 7))


def test_edit_distance_of_large_karyotypes(spark):
    """Eight walks a side, some equal, some repeated; the threshold drops short walks and small costs."""
    widths = {1: 10, 2: 20, 3: 30, 4: 5, 5: 8}
    nodes = spark.createDataFrame(list(widths.items()), "node_id int, width long")
    rng = np.random.default_rng(7)
    walks = {}
    for kar in (1, 2, 3):
        walks[kar] = [(bool(rng.integers(0, 4) == 0), (rng.integers(1, 6, rng.integers(1, 6)) * rng.choice([-1, 1])).tolist()) for _ in range(5)]
    walks[1] += [(False, [1, 2, 3])] * 3
    walks[2] += [(False, [-3, -2, -1])] + [(False, [1, 2, 3, 4])] * 2
    rows = [(kar, 100 * kar + w, circ, p + 1, len(x), v) for kar, some in walks.items() for w, (circ, x) in enumerate(some) for p, v in enumerate(x)]
    steps = spark.createDataFrame(rows, "kar_id long, walk_id long, circular boolean, pos long, n long, node int")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 1, 3), (4, 1, 1)], "pair_id long, kar_a long, kar_b long")

    def opened(circ, x):
        if not circ:
            return x
        back = [-v for v in reversed(x)]
        return min(r[k:] + r[:k] for r in (x, back) for k in range(len(x)))

    def price(x, y):
        wide = lambda z: [widths[abs(v)] for v in z]
        return sum(wide(x)) + sum(wide(y)) - 2 * max(lcs(x, wide(x), y), lcs(x, wide(x), [-v for v in reversed(y)]))

    for thresh in (0, 25):
        got = {r.pair_id: r.edit for r in D.edit_distance(pairs, steps, nodes, thresh).collect()}
        for pid, a, b in ((1, 1, 2), (2, 2, 3), (3, 1, 3), (4, 1, 1)):
            xs, ys = ([opened(*w) for w in walks[k] if sum(widths[abs(v)] for v in w[1]) > thresh] for k in (a, b))
            n = max(len(xs), len(ys))
            xs, ys = xs + [[]] * (n - len(xs)), ys + [[]] * (n - len(ys))
            cost = [[price(x, y) for y in ys] for x in xs]
            best = {0: (0, 0)}
            for i in range(n):
                nxt = {}
                for mask, (t, c) in best.items():
                    for j in range(n):
                        if not mask >> j & 1:
                            v = (t + cost[i][j], c + (cost[i][j] if cost[i][j] > thresh else 0))
                            key = mask | 1 << j
                            nxt[key] = min(nxt.get(key, v), v)
                best = nxt
            assert got[pid] == best[(1 << n) - 1][1], (thresh, pid)

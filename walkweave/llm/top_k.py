"""Exact inner-product search by the threshold algorithm over sorted lists, one for each dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a candidate block, of a query block, and queries that read the lists together.
CANDIDATES, QUERIES, TOGETHER = 8192, 2048, 256
#: Doubles hold integers exactly below this.
EXACT = float(1 << 53)


def threshold_search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """For each query the places (in ``vectors``, which come in order of ids) and scores of its k best, ties to smaller ids.

    The lists of all dimensions are read from the end that a query's sign favours, to ever greater depths. What has come
    up is scored for all queries that read together. A query is done when its k-th score exceeds the sum of its weights
    times the last values read, which nothing unread can beat; equal scores are read on, as a smaller id might follow.
    """
    n, d = vectors.shape
    if queries.size and vectors.size and d * float(np.abs(vectors).max()) * float(np.abs(queries).max()) >= EXACT:
        vectors, queries = (np.array([[int(x) for x in r] for r in m], object) for m in (vectors, queries))
    lists = np.argsort(vectors, axis=0, kind="stable") if d else np.zeros((n, 0), int)
    ascending = np.take_along_axis(vectors, lists, 0)
    out = []
    for at in range(0, len(queries), TOGETHER):
        q, own = queries[at:at + TOGETHER], query_ids[at:at + TOGETHER]
        up, down = np.where(q > 0, q, 0), np.where(q < 0, q, 0)
        seen = np.zeros(n, bool)
        places = np.zeros(0, int)
        scores = np.zeros((len(q), 0), vectors.dtype)
        depth, done = 0, n == 0
        while not done:
            depth = min(n, max(2 * depth, k))
            high, low = (up != 0).any(0), (down != 0).any(0)
            fresh = np.zeros(n, bool)
            fresh[lists[n - depth:, high]] = True
            fresh[lists[:depth, low]] = True
            if depth == n:
                fresh[:] = True
            fresh &= ~seen
            new = np.flatnonzero(fresh)
            seen |= fresh
            more = q @ vectors[new].T
            places, scores = np.concatenate((places, new)), np.concatenate((scores, more), axis=1)
            if depth == n or len(places) == n:
                break
            if len(places) > k:
                bound = up @ ascending[n - depth] + down @ ascending[depth - 1]
                # The query itself may be among those scored: one more is asked for.
                done = bool((np.partition(scores, len(places) - k - 1, axis=1)[:, len(places) - k - 1] > bound).all())
        order = np.argsort(places)
        places, scores = places[order], scores[:, order]
        for s, i in zip(scores, own, strict=True):
            kept = np.flatnonzero(ids[places] != i)
            s = s[kept]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                kept, s = kept[s >= least], s[s >= least]
            best = np.argsort(-s, kind="stable")[:k]
            out.append((places[kept[best]], s[best]))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64,
          candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """The k best partners of every query by integer inner product: query_id, rank (from 1), vec_id, score.

    Components are floor(scale * x). Queries are the rows where ``is_query`` holds, candidates all rows but the query's
    own (rows of its id). Blocks of queries meet blocks of candidates; a meeting keeps k rows a query, and the blocks'
    results are ranked. Rows whose id or vector is null, or whose vector holds a null, NaN or infinite component, take no
    part; only vectors of one length are compared. An id that is a query in several rows asks with its least vector;
    other columns are ignored; an empty table, or one without partners, gives an empty result.
    """
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    held = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & sound)
    rows = held.select(F.col(vec_id).cast("long").alias("id"), ints.alias("v"), F.size(vector).alias("d"))
    asked = held.where(is_query).select(F.col(vec_id).cast("long").alias("id"), ints.alias("v"), F.size(vector).alias("d")).groupBy("id", "d").agg(F.min("v").alias("v"))
    across = max(1, -(-rows.count() // candidates))
    down = max(1, -(-asked.count() // queries))
    left = rows.select("*", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(across)).alias("c"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("q"))
    right = asked.select("*", F.pmod(F.xxhash64("id"), F.lit(down)).alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("c"))

    def meet(some: pa.Table, ask: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not some.num_rows or not ask.num_rows:
            return empty
        flat = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        some = some.sort_by("id")
        ids, own = some.column("id").to_numpy(), ask.column("id").to_numpy()
        found = threshold_search(flat(some), ids, flat(ask), own, k)
        if not found:
            return empty
        return pa.table({"query_id": np.repeat(own, [len(p) for p, _ in found]), "vec_id": ids[np.concatenate([p for p, _ in found])],
                         "score": np.concatenate([s for _, s in found]).astype(np.int64)})

    near = left.groupBy("c", "q", "d").cogroup(right.groupBy("c", "q", "d")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

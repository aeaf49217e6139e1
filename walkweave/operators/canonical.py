"""Canonical forms, keys and de-duplication of walks and karyotypes.

Two walks are equal when one is the other's reverse complement or, for circular walks, a rotation of
either; two karyotypes are equal when their multisets of walks are.  Linear walks need no ordering at
all: the 128-bit key of a walk is an order-free aggregate over its steps, so a long walk is combined
map-side like any sum.  Circular walks need their least rotation: short ones take it from an array,
long ones by prefix doubling over their steps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from walkweave.functions.arrays import canonical_walk
from walkweave.operators.skew import BLOCK, number_rows
from walkweave.operators.traversal import list_steps
from walkweave.session import cut

#: circular walks up to this length are rotated as arrays
ARRAY_STEPS = 256

KEY = ("len", "circ", "h1", "h2")


def collect_walks(steps: DataFrame, keys: Sequence[str] = ("kar_id", "walk_id")) -> DataFrame:
    """Walks as arrays ``(keys, circular, n, nodes)``; the caller bounds ``n``."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "node")))
    return steps.groupBy(*keys).agg(
        F.first("circular").alias("circular"),
        F.first("n").alias("n"),
        F.transform(pairs, lambda p: p["node"]).alias("nodes"),
    )


def long_walks(steps: DataFrame, bound: int | None, array_steps: int) -> int:
    """Length of the longest walk if it may exceed ``array_steps``, else 0 (``bound`` spares the lookup)."""
    if bound is not None and bound <= array_steps:
        return 0
    longest = steps.agg(F.max("n")).first()[0] or 0
    return longest if longest > array_steps else 0


def _halves(pos: Column, node: Column) -> tuple[Column, Column]:
    return (
        F.bit_xor(F.xxhash64(F.lit(11), pos, node)),
        F.bit_xor(F.xxhash64(F.lit(29), pos, node)),
    )


def _order_free_key(steps: DataFrame, keys: Sequence[str], both_strands: bool) -> DataFrame:
    f1, f2 = _halves(F.col("pos"), F.col("node"))
    best = F.struct(f1.alias("h1"), f2.alias("h2"))
    if both_strands:
        r1, r2 = _halves(F.col("n") + 1 - F.col("pos"), -F.col("node"))
        best = F.least(best, F.struct(r1.alias("h1"), r2.alias("h2")))
    return steps.groupBy(*keys).agg(
        F.first("n").alias("len"), F.first("circular").alias("circ"), best.alias("_k")
    ).select(*keys, "len", "circ", "_k.h1", "_k.h2")


def array_key(canonical: Column) -> list[Column]:
    """The two hash columns of a canonical walk array."""
    return [F.xxhash64(F.lit(11), canonical).alias("h1"), F.xxhash64(F.lit(29), canonical).alias("h2")]


def walk_keys(
    steps: DataFrame,
    keys: Sequence[str] = ("kar_id", "walk_id"),
    bound: int | None = None,
    array_steps: int = ARRAY_STEPS,
) -> DataFrame:
    """``(keys, len, circ, h1, h2)``: equal exactly for equal walks (up to 128-bit hashing).

    Walks of up to ``array_steps`` steps hash their canonical array; equal walks have equal lengths, so
    they always take the same way.  ``bound`` is an upper bound on walk lengths, if one is known.
    """
    longest = long_walks(steps, bound, array_steps)
    short = steps.filter(F.col("n") <= array_steps) if longest else steps
    canon = collect_walks(short, keys).withColumn("c", canonical_walk(F.col("nodes"), F.col("circular")))
    out = canon.select(*keys, F.col("n").alias("len"), F.col("circular").alias("circ"), *array_key(F.col("c")))
    if longest:
        long = steps.filter(F.col("n") > array_steps)
        turned = canonical_rings(long.filter("circular"), keys, longest)
        out = out.unionByName(_order_free_key(long.filter("NOT circular"), keys, both_strands=True))
        out = out.unionByName(_order_free_key(turned, keys, both_strands=False))
    return out


def list_keys(walks: DataFrame, keys: Sequence[str] = ("kar_id", "walk_id"), bound: int | None = None,
              array_steps: int = ARRAY_STEPS) -> DataFrame:
    """:func:`walk_keys` of walks as lists ``(keys, circular, nodes)``; no shuffle up to ``array_steps`` steps."""
    size = F.size("nodes")
    longest = 0 if bound is not None and bound <= array_steps else walks.agg(F.max(size)).first()[0] or 0
    short = walks.filter(size <= array_steps) if longest > array_steps else walks
    canon = short.withColumn("c", canonical_walk(F.col("nodes"), F.col("circular")))
    out = canon.select(*keys, size.cast("long").alias("len"), F.col("circular").alias("circ"), *array_key(F.col("c")))
    if longest > array_steps:
        long = list_steps(walks.filter(size > array_steps).select(*keys, "circular", "nodes"))
        out = out.unionByName(walk_keys(long, keys, longest, array_steps))
    return out


def canonical_rings(steps: DataFrame, keys: Sequence[str], longest: int) -> DataFrame:
    """Steps of circular walks in canonical rotation and strand, by prefix doubling.

    Both strands of a walk share one ranking.  After round ``r`` positions are ranked by the next
    ``2**r`` steps; the canonical start is a position of least rank.
    """
    key = F.struct(*keys)
    both = steps.select(
        key.alias("_w"), "circular", "n",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("d"), (F.col("pos") - 1).alias("p"), F.col("node").alias("v")),
                F.struct(F.lit(1).alias("d"), (F.col("n") - F.col("pos")).alias("p"), (-F.col("node")).alias("v")),
            )
        ).alias("e"),
    ).select("_w", "circular", "n", "e.d", "e.p", "e.v")
    both = cut(both.withColumn("rank", F.col("v").cast("long")))
    for r in range(math.ceil(math.log2(max(longest, 2)))):
        far = both.select("_w", "d", F.col("rank").alias("rank2"), F.pmod(F.col("p") - (1 << r), F.col("n")).alias("p"))
        pairs = both.join(far, ["_w", "d", "p"])
        names = pairs.select("_w", "rank", "rank2").distinct()
        names = number_rows(
            names, "_w", F.floor(F.col("rank") / BLOCK), [F.col("rank"), F.col("rank2")], hot=None, pos="name",
            total="names",
        )
        both = cut(
            pairs.join(names, ["_w", "rank", "rank2"]).select("_w", "circular", "n", "d", "p", "v", F.col("name").alias("rank"))
        )
    starts = both.groupBy("_w").agg(F.min(F.struct("rank", "d", "p")).alias("m"))
    return both.join(starts.select("_w", "m.d", F.col("m.p").alias("p0")), ["_w", "d"]).select(
        *[F.col(f"_w.{k}").alias(k) for k in keys],
        "circular",
        (F.pmod(F.col("p") - F.col("p0"), F.col("n")) + 1).alias("pos"),
        "n",
        F.col("v").cast("int").alias("node"),
    )


def ring_steps(steps: DataFrame, keys: Sequence[str] = ("kar_id", "walk_id"), bound: int | None = None,
               array_steps: int = ARRAY_STEPS) -> DataFrame:
    """Circular walks in canonical rotation and strand; linear walks as they are."""
    longest = long_walks(steps, bound, array_steps)
    cols = [*keys, "circular", "pos", "n", "node"]
    rings = steps.filter("circular")
    short = collect_walks(rings.filter(F.col("n") <= array_steps) if longest else rings, keys)
    turned = short.select(
        *keys, "circular", "n", F.posexplode(canonical_walk(F.col("nodes"), F.lit(True))).alias("p", "node")
    ).select(*keys, "circular", (F.col("p") + 1).cast("long").alias("pos"), "n", "node")
    out = steps.filter("NOT circular").select(cols).unionByName(turned)
    if longest:
        out = out.unionByName(canonical_rings(rings.filter(F.col("n") > array_steps), keys, longest).select(cols))
    return out


def canonical_steps(steps: DataFrame, keys: Sequence[str] = ("kar_id", "walk_id"), bound: int | None = None,
                    array_steps: int = ARRAY_STEPS) -> DataFrame:
    """Every walk in canonical strand (and rotation), one row per step."""
    turned = ring_steps(steps, keys, bound, array_steps)
    linear = turned.filter("NOT circular")
    # position m against its mirror image: the first m where they differ decides the strand
    mirror = linear.select(
        *keys,
        F.least(F.col("pos"), F.col("n") + 1 - F.col("pos")).alias("m"),
        F.when(F.col("pos") * 2 <= F.col("n") + 1, F.col("node")).alias("x"),
        F.when(F.col("pos") * 2 >= F.col("n") + 1, -F.col("node")).alias("y"),
    )
    sides = mirror.groupBy(*keys, "m").agg(F.max("x").alias("x"), F.max("y").alias("y")).filter("x <> y")
    strand = sides.groupBy(*keys).agg(F.min_by(F.col("x") > F.col("y"), "m").alias("flip"))
    flip = F.coalesce(F.col("flip"), F.lit(False))  # a walk equal to its own mirror has no differing step
    flipped = linear.join(strand, list(keys), "left").withColumn("flip", flip).select(
        *keys, "circular",
        F.when(F.col("flip"), F.col("n") + 1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"),
        "n",
        F.when(F.col("flip"), -F.col("node")).otherwise(F.col("node")).alias("node"),
    )
    return flipped.unionByName(turned.filter("circular"))


def representatives(keyed: DataFrame, item: str, out: str = "rep_id") -> DataFrame:
    """The least item of every equivalence class, and the class size (no window: classes may be hot)."""
    classes = keyed.groupBy(*KEY).agg(F.min(item).alias(out), F.count(F.lit(1)).alias("members"))
    return keyed.join(classes, list(KEY))


def unique_walks(keyed: DataFrame, item: str = "walk_id", mode: str = "all") -> DataFrame:
    """First walk of each class; ``mode`` is ``all``, ``lin`` or ``circular``."""
    if mode not in ("all", "lin", "circular"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode != "all":
        keyed = keyed.filter(F.col("circ") == (mode == "circular"))
    return keyed.groupBy(*KEY).agg(F.min(item).alias(item), F.count(F.lit(1)).alias("members"))


def karyotype_keys(keyed: DataFrame, kar: str = "kar_id") -> DataFrame:
    """Order-free key of the multiset of walks of a karyotype: ``(kar, len, circ, h1, h2)``.

    ``len`` is the number of walks and ``circ`` tells whether any is circular, so the result feeds
    :func:`representatives` as well.
    """
    counted = keyed.groupBy(kar, *KEY).agg(F.count(F.lit(1)).alias("c"))
    part = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), *KEY, "c"))
    return counted.groupBy(kar).agg(
        F.sum("c").alias("len"), F.bool_or("circ").alias("circ"), part(17).alias("h1"), part(41).alias("h2")
    )


def drop_circular(steps: DataFrame, kar: str = "kar_id") -> DataFrame:
    """Karyotypes without any circular walk."""
    rings = steps.filter("circular").select(kar).distinct()
    return steps.join(rings, kar, "left_anti")


def sort_key(walks: DataFrame, kar: str = "kar_id") -> DataFrame:
    """Readable key: canonical walks with ``C``/``L`` suffix, sorted (short karyotypes only)."""
    text = F.concat(
        F.array_join(F.transform(canonical_walk(F.col("nodes"), F.col("circular")), lambda v: v.cast("string")), ", "),
        F.when(F.col("circular"), "C").otherwise("L"),
    )
    return walks.groupBy(kar).agg(F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("key"))


# 64-bit FNV-1a offset basis and prime, walk marker byte and shape letters.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
WALK_MARK = 0xFE


@F.pandas_udf(StringType())
def fnv_key(karyotypes: pd.Series) -> pd.Series:
    """16 hex digits over canonical walks and their reverse complements (empty: sixteen zeros).

    Input: array of (nodes, circular) in canonical form.
    """

    def one(walks) -> str:
        if walks is None or len(walks) == 0:
            return "0" * 16
        entries = []
        for w in walks:
            nodes, ring = np.asarray(w["nodes"], dtype=np.int32), bool(w["circular"])
            entries += [(tuple(nodes.tolist()), ring), (tuple((-nodes[::-1]).tolist()), ring)]
        h = FNV_OFFSET
        for nodes, ring in sorted(entries):
            data = bytes([WALK_MARK]) + (b"C" if ring else b"L") + np.asarray(nodes, dtype="<i4").tobytes()
            for byte in data:
                h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return karyotypes.map(one)


def fnv_keys(walks: DataFrame, kar: str = "kar_id") -> DataFrame:
    """``(kar, hash)`` for walks as arrays (short karyotypes only; :func:`karyotype_keys` has no such limit)."""
    shape = F.struct(canonical_walk(F.col("nodes"), F.col("circular")).alias("nodes"), F.col("circular"))
    packed = walks.select(kar, shape.alias("w")).groupBy(kar).agg(F.array_sort(F.collect_list("w")).alias("w"))
    return packed.select(kar, fnv_key("w").alias("hash"))

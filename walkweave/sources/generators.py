"""Small synthetic graphs: reciprocal duplications, a three-way exchange, breakage-fusion-bridge walks."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Walks of the example rearrangements (segments A.. are 1..).
THREE_WAY = ([1, 2, 3], [4, 5, 6], [7, 8, 9], [1, 2, 5, 6], [4, 5, 8, 9], [7, 8, 2, 3])
RECIPROCAL = {
    "cis1": ([1, 2, 3], [4, 5, 6], [4, 5, 6], [1, 2, 5, 2, 3]),
    "cis2": ([1, 2, 3], [1, 2, 3], [4, 5, 6], [4, 5, 2, 5, 6]),
    "trans": ([1, 2, 3], [4, 5, 6], [4, 5, 2, 3], [1, 2, 5, 6]),
}


def segments(spark: SparkSession, count: int, width: int, per_chromosome: int) -> DataFrame:
    """``count`` equal segments in chromosomes of ``per_chromosome``: ``(node_id, seqnames, start, end, width, cn)``."""
    k = F.col("id")
    return spark.range(count).select(
        (k + 1).cast("int").alias("node_id"), (F.floor(k / per_chromosome) + 1).cast("string").alias("seqnames"),
        (k % per_chromosome * width + 1).alias("start"), ((k % per_chromosome + 1) * width).alias("end"),
        F.lit(width).cast("long").alias("width"), F.lit(1).alias("cn"))


def walk_steps(spark: SparkSession, walks: Sequence[Sequence[int]], circular: bool | Sequence[bool] = False, kar_id: int = 0,
               background: int = 0, nodes: int | None = None) -> DataFrame:
    """Steps ``(kar_id, walk_id, circular, pos, n, node)`` of given walks.

    ``background`` adds that many plain walks over all ``nodes``.
    """
    walks = [list(w) for w in walks]
    rings = [circular] * len(walks) if isinstance(circular, bool) else list(circular)
    if len(rings) != len(walks):
        raise ValueError("give one circular flag or one per walk")
    if background:
        top = nodes or max(abs(v) for w in walks for v in w)
        walks += [list(range(1, top + 1))] * background
        rings += [False] * background
    rows = [(kar_id, w, rings[w], p + 1, len(walk), v) for w, walk in enumerate(walks) for p, v in enumerate(walk)]
    return spark.createDataFrame(rows, "kar_id long, walk_id long, circular boolean, pos long, n long, node int")


def bridge_walk(tiles: int, cycles: int = 5, seed: int = 1) -> list[int]:
    """Breakage-fusion-bridge: each cycle breaks the walk, keeps the larger side and doubles it head to head."""
    rng = random.Random(seed)
    walk = list(range(1, tiles + 1))
    for _ in range(cycles):
        size = len(walk)
        at = rng.randint(2, size - 1)
        flipped = lambda part: [-v for v in reversed(part)]
        if at <= size / 2:
            part = walk[at - 1 :]
            walk = flipped(part) + part
        else:
            part = walk[:at]
            walk = part + flipped(part)
    return walk


def bench_walks(seed: int = 42) -> dict[str, tuple[list[int], ...]]:
    """The standard graphs by name."""
    return {
        "bfb_small": (bridge_walk(8, 5, seed),),
        "bfb_medium": (bridge_walk(16, 8, seed),),
        "repdup_cis1": RECIPROCAL["cis1"],
        "repdup_trans": RECIPROCAL["trans"],
    }

"""Copy-number graphs as tables: nodes, edges, loose ends and the wiring of node copies.

Sides are ``'left'``/``'right'``; node 0 is the outside world.  A junction is stored once, with its
smaller (node, side) end first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkweave.operators.skew import BLOCK


def with_next(steps: DataFrame, k: int, keys: Sequence[str] = ("walk_id",), block: int = BLOCK,
              short_rings: bool = False) -> DataFrame:
    """Add ``nx1 .. nx{k-1}``: the following nodes of each step (wrapping on circular walks).

    Positions are cut into blocks and the first ``k-1`` steps of a block are copied to the block
    before it, so a long walk is spread over tasks.  A wrap is allowed while ``k <= n + 1``; with
    ``short_rings`` shorter rings are followed for one more lap and end there.
    """
    span = k - 1
    block = max(block, k)  # the copied steps must fit into one block
    wraps = F.col("circular") & (F.col("pos") <= span)
    if not short_rings:
        wraps = wraps & (F.lit(span) <= F.col("n"))
    placed = steps.select(
        "*",
        F.explode(
            F.when(wraps, F.array(F.col("pos"), F.col("pos") + F.col("n"))).otherwise(F.array("pos"))
        ).alias("_at"),
    )
    own = F.floor((F.col("_at") - 1) / block)
    halo = (own > 0) & ((F.col("_at") - 1) % block < span)
    placed = placed.select(
        "*", F.explode(F.when(halo, F.array(own, own - 1)).otherwise(F.array(own))).alias("_blk")
    )
    w = Window.partitionBy(*keys, "_blk").orderBy("_at")
    nexts = [F.lead("node", j).over(w).alias(f"nx{j}") for j in range(1, k)]
    return (
        placed.select("*", *nexts)
        .filter((F.col("_at") <= F.col("n")) & (F.col("_blk") == F.floor((F.col("_at") - 1) / block)))
        .drop("_at", "_blk")
    )


def walk_nodes(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Node copy numbers of the union of walks (visits)."""
    return steps.groupBy(*by, F.abs("node").alias("node_id")).agg(F.count(F.lit(1)).alias("cn"))


def walk_edges(
    steps: DataFrame,
    by: Sequence[str] = (),
    per_chromosome: int | None = None,
    keys: Sequence[str] = ("walk_id",),
    block: int = BLOCK,
) -> DataFrame:
    """Junctions of the union of walks with their multiplicity.

    ``type`` is ``REF`` for the junction of neighbouring segments (same chromosome when
    ``per_chromosome`` segments make up one), ``ALT`` otherwise.
    """
    hops = with_next(steps, 2, keys, block).filter(F.col("nx1").isNotNull())
    return count_junctions(hops, by, per_chromosome)


def walk_external(
    steps: DataFrame,
    by: Sequence[str] = (),
    per_chromosome: int | None = None,
    keys: Sequence[str] = ("walk_id",),
    block: int = BLOCK,
    deal: bool = False,
) -> DataFrame:
    """Junctions and loose ends of the union of walks in one aggregation over the steps.

    Every step contributes the junction to its successor or, at the end of a linear walk, a loose
    edge; the first step of a linear walk contributes the loose edge before it.  With ``deal`` the
    edges of a graph lie in one partition.
    """
    hops = with_next(steps, 2, keys, block)
    first = (F.col("pos") == 1) & ~F.col("circular")
    ends = hops.withColumn("_in", F.explode(F.when(first, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    a = F.when(F.col("_in"), F.lit(None)).otherwise(F.col("node"))
    b = F.when(F.col("_in"), F.col("node")).otherwise(F.col("nx1"))
    return count_junctions(ends.select(*by, a.alias("node"), b.alias("nx1")), by, per_chromosome, deal)


def _end(node: Column, leaving: bool) -> Column:
    """(node, side) where a walk leaves or enters a signed node."""
    forward, backward = ("right", "left") if leaving else ("left", "right")
    return F.struct(F.abs(node).alias("n"), F.when(node > 0, forward).otherwise(backward).alias("side"))


def count_junctions(hops: DataFrame, by: Sequence[str], per_chromosome: int | None, deal: bool = False) -> DataFrame:
    """Count hops ``node -> nx1``; a NULL on either side stands for the outside world.  With ``deal``
    hops are shuffled by ``by``, so that later work on whole graphs finds them together.

    A loose left end is ``(0, right) -> (node, left)``, a loose right end ``(node, right) -> (0, left)``.
    """
    out, into = _end(F.col("node"), True), _end(F.col("nx1"), False)
    known = F.coalesce(F.when(F.col("node").isNull(), into), F.when(F.col("nx1").isNull(), out))
    left = known["side"] == "left"
    zero = lambda side: F.struct(F.lit(0).alias("n"), F.lit(side).alias("side"))
    lo = F.when(known.isNull(), F.least(out, into)).when(left, zero("right")).otherwise(known)
    hi = F.when(known.isNull(), F.greatest(out, into)).when(left, known).otherwise(zero("left"))
    flat = hops.select(*by, lo.alias("lo"), hi.alias("hi")).select(
        *by, F.col("lo.n").alias("n1"), F.col("lo.side").alias("n1_side"),
        F.col("hi.n").alias("n2"), F.col("hi.side").alias("n2_side"),
    )
    if deal:
        flat = flat.repartition(*by)
    ref = (F.col("n2") == F.col("n1") + 1) & (F.col("n1_side") == "right") & (F.col("n2_side") == "left")
    if per_chromosome:
        ref = ref & (F.col("n1") % per_chromosome != 0)
    loose = (F.col("n1") == 0) | (F.col("n2") == 0)
    return (
        flat.groupBy(*by, "n1", "n1_side", "n2", "n2_side")
        .agg(F.count(F.lit(1)).alias("cn"))
        .withColumn("type", F.when(loose, "LOO").when(ref, "REF").otherwise("ALT"))
    )


def loose_ends(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Copies of each node side that no junction takes up: ``(node_id, orientation, node_cn, cn)``."""
    ends = edges.select(
        *by,
        F.expr("stack(2, n1, n1_side, n2, n2_side) as (node_id, orientation)"),
        "cn",
    )
    used = ends.groupBy(*by, "node_id", "orientation").agg(F.sum("cn").alias("used"))
    sides = nodes.select(
        *by, "node_id", F.col("cn").alias("node_cn"), F.explode(F.array(F.lit("left"), F.lit("right"))).alias("orientation")
    )
    return sides.join(used, [*by, "node_id", "orientation"], "left").select(
        *by, "node_id", "orientation", "node_cn",
        (F.col("node_cn") - F.coalesce("used", F.lit(0))).cast("long").alias("cn"),
    )


def external_nodes(external: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Node copy numbers ``(by, node_id, cn)`` of graphs with their loose ends: every copy of a node has one left end."""
    ends = external.select(*by, F.expr("stack(2, n1, n1_side, n2, n2_side) as (node_id, _side)"), "cn").filter("node_id > 0 AND _side = 'left'")
    return ends.groupBy(*by, "node_id").agg(F.sum("cn").alias("cn"))


def default_loose_cn(nodes: DataFrame) -> DataFrame:
    """A missing loose copy number means a chromosome end: every copy is loose."""
    return nodes.withColumns(
        {c: F.coalesce(F.col(c), F.col("cn")) for c in ("loose_cn_left", "loose_cn_right")}
    )


def loose_edges(loose: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Loose ends as ``LOO`` edges to node 0 (left ends first, then right ends)."""
    left = F.col("orientation") == "left"
    return loose.filter("cn > 0").select(
        *by,
        F.when(left, 0).otherwise(F.col("node_id")).cast("int").alias("n1"),
        F.lit("right").alias("n1_side"),
        F.when(left, F.col("node_id")).otherwise(0).cast("int").alias("n2"),
        F.lit("left").alias("n2_side"),
        "cn",
        F.lit("LOO").alias("type"),
    )


def _dealt_external(nodes: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """:func:`graph_external` by one shuffle: edges, node sides and the ends of edges meet in one aggregation of a graph's rows."""
    none = F.lit(None)
    ends = ["n1", "n1_side", "n2", "n2_side"]
    rows = edges.select(*by, *ends, F.col("cn").cast("long").alias("cn"), "type").unionByName(nodes.select(
        *by, F.col("node_id").alias("n1"), none.cast("string").alias("n1_side"), F.lit(0).alias("n2"), none.cast("string").alias("n2_side"),
        F.col("cn").cast("long").alias("cn"), none.cast("string").alias("type")))
    # a node gives both of its sides, an edge itself and the copies that its ends take up (none of a graph without a number)
    part = lambda edge, n1, side, n2, side2, cn, own, type_: F.struct(
        F.lit(edge).alias("edge"), n1.alias("n1"), side.alias("n1_side"), n2.alias("n2"), side2.alias("n2_side"), cn.cast("long").alias("cn"),
        own.cast("long").alias("own"), type_.alias("type"))
    c, no = F.col, none.cast("string")
    known = F.lit(True)
    for k in by:
        known = known & c(k).isNotNull()
    taken = F.when(known, -c("cn")).otherwise(F.lit(0))
    sides = F.array(*[part(False, c("n1"), F.lit(s), F.lit(0), no, c("cn"), c("cn"), no) for s in ("left", "right")])
    links = F.array(part(True, *map(c, ends), c("cn"), c("cn"), c("type")), part(False, c("n1"), c("n1_side"), F.lit(0), no, taken, none, no),
                    part(False, c("n2"), c("n2_side"), F.lit(0), no, taken, none, no))
    flat = rows.repartition(*by).select(*by, F.explode(F.when(c("type").isNull(), sides).otherwise(links)).alias("_e")).select(*by, "_e.*")
    sums = flat.groupBy(*by, "edge", *ends, "type").agg(F.sum("cn").alias("cn"), F.max("own").alias("own")).filter(
        "edge OR (own IS NOT NULL AND cn > 0)")
    left = ~c("edge") & (c("n1_side") == "left")
    right = ~c("edge") & (c("n1_side") == "right")
    return sums.select(
        *by, F.when(left, 0).otherwise(c("n1")).cast("int").alias("n1"), F.when(c("edge"), c("n1_side")).otherwise("right").alias("n1_side"),
        F.when(left, c("n1")).when(right, 0).otherwise(c("n2")).cast("int").alias("n2"), F.when(c("edge"), c("n2_side")).otherwise("left").alias("n2_side"),
        "cn", F.when(c("edge"), c("type")).otherwise("LOO").alias("type"))


def _before(df: DataFrame, keys, bucket, order, value: str, out: str, split: bool) -> DataFrame:
    """Exclusive running sum inside ``keys``; in two phases over ``bucket`` when ``split``."""
    frame = (Window.unboundedPreceding, -1)
    if not split:
        w = Window.partitionBy(*keys).orderBy(*bucket, *order).rowsBetween(*frame)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    totals = df.groupBy(*keys, *bucket).agg(F.sum(value).alias("_t"))
    w = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(*frame)
    totals = totals.select(*keys, *bucket, F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_o"))
    w = Window.partitionBy(*keys, *bucket).orderBy(*order).rowsBetween(*frame)
    return (
        df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
        .join(totals, [*keys, *bucket])
        .withColumn(out, F.col(out) + F.col("_o"))
        .drop("_o")
    )


def _copies(df: DataFrame, keys: Sequence[str], split: bool, chunk: int = 1 << 14) -> DataFrame:
    """One row per copy (``_k = 0 .. cn-1``), generated chunk by chunk; ``split`` spreads the chunks.

    Chunks are few bytes, so their partitions are numbered: left to size they would be merged into one task.
    """
    chunks = df.filter("cn > 0").withColumn(
        "_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("cn") - 1) / chunk)))
    )
    first = F.col("_c") * chunk
    last = F.least(first + chunk, F.col("cn")) - 1
    if split:
        chunks = chunks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_c")
    return chunks.withColumn("_k", F.explode(F.sequence(first, last))).drop("_c")


def subids(external: DataFrame, by: Sequence[str] = (), split: bool = False) -> DataFrame:
    """Number the copies of all external edges: ``first_subid`` is the 0-based id of the first copy.

    Graph edges come first, then left loose ends, then right loose ends; ids are dense in a graph.
    """
    rank = F.when(F.col("type") != "LOO", 0).when(F.col("n1") == 0, 1).otherwise(2)
    ext = external.filter("cn > 0").withColumn("_cls", rank)
    return _before(
        ext, by, ["_cls", "n1"], ["n1_side", "n2", "n2_side"], "cn", "first_subid", split
    ).drop("_cls")


def graph_external(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = (), deal: bool = False) -> DataFrame:
    """Graph edges plus the loose ends that balance every node.

    With ``deal`` nodes and edges are shuffled once, by graph, and the result of a graph lies in one partition; a node and an
    edge must then be one row of its graph.
    """
    cols = [*by, "n1", "n1_side", "n2", "n2_side", "cn", "type"]
    if deal:
        return _dealt_external(nodes, edges, by).select(cols)
    return edges.select(cols).unionByName(loose_edges(loose_ends(nodes, edges, by), by).select(cols))


def wiring(external: DataFrame, by: Sequence[str] = (), split: bool = False, deal: bool = False) -> DataFrame:
    """One row per node copy: ``(id, n, copy, left, right)``.

    The copies of a node side are numbered by (role of the end, edge copy); a left and a right end
    with the same number make one wiring row.  ``external`` comes from :func:`subids`; ``split``
    shares the copies of one huge edge among tasks.  ``id`` orders rows by (node, copy).  With ``deal``
    edges are shuffled once, by graph, and the rows of a graph lie in one partition (not with ``split``).
    """
    if deal and not split:
        external = external.repartition(*by)
    ends = external.select(
        *by,
        F.expr("stack(2, n1, n1_side, 1, n2, n2_side, 2) as (n, side, role)"),
        "first_subid",
        "cn",
    ).filter("n > 0")
    placed = _before(ends, [*by, "n", "side"], ["role"], ["first_subid"], "cn", "slot", split=False)
    subid = F.col("first_subid") + F.col("_k") + 1
    return (
        _copies(placed, [*by, "n", "side"], split)
        .groupBy(*by, "n", (F.col("slot") + F.col("_k") + 1).cast("long").alias("copy"))
        .agg(
            F.max(F.when(F.col("side") == "left", subid)).alias("left"),
            F.max(F.when(F.col("side") == "right", subid)).alias("right"),
        )
        .select(*by, wiring_id(F.col("n"), F.col("copy")).alias("id"), "n", "copy", "left", "right")
    )


def largest_wiring(external: DataFrame, by: Sequence[str] = ()) -> int:
    """Wiring rows of the largest graph, from its external edges: an edge copy takes two ends of node copies, a loose one one."""
    ends = F.when(F.col("type") == "LOO", F.col("cn")).otherwise(2 * F.col("cn"))
    return (external.groupBy(*by).agg(F.sum(ends).alias("_ends")).agg(F.max("_ends")).first()[0] or 0) // 2


def wiring_id(n: Column, copy: Column) -> Column:
    """Node and copy in one number that may be doubled; fails beyond 2^30 nodes or 2^32 copies of one."""
    fits = (n < 1 << 30) & (copy < 1 << 32)
    return F.when(fits, F.shiftleft(n.cast("long"), 32) + copy).otherwise(F.raise_error(F.lit("too many nodes or copies for a wiring id")).cast("long"))


def loose_subids(external: DataFrame, by: Sequence[str] = (), split: bool = False) -> DataFrame:
    loo = external.filter("type = 'LOO'")
    return _copies(loo, [*by, "n1", "n2"], split).select(
        *by, (F.col("first_subid") + F.col("_k") + 1).cast("long").alias("subid")
    )


def dup_junctions(edges: DataFrame) -> DataFrame:
    """Tandem duplications: both ends on one node, on opposite sides."""
    return edges.filter((F.col("n1") == F.col("n2")) & (F.col("n1_side") != F.col("n2_side")))


def del_junctions(edges: DataFrame) -> DataFrame:
    """Deletions of one node: ALT junction right->left skipping exactly one segment, with that segment."""
    skips = (
        (F.col("type") == "ALT")
        & (F.abs(F.col("n1") - F.col("n2")) == 2)
        & (F.col("n1_side") == "right")
        & (F.col("n2_side") == "left")
    )
    return edges.filter(skips).withColumn("node_id", F.bround((F.col("n1") + F.col("n2")) / 2).cast("int"))


def smoothed_cn(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Node copy numbers with tandem duplications taken out and single-node deletions filled in."""
    minus = dup_junctions(edges).select(*by, F.col("n1").alias("node_id"), (-F.col("cn")).alias("delta"))
    plus = del_junctions(edges).select(*by, "node_id", F.col("cn").alias("delta"))
    delta = minus.unionByName(plus).groupBy(*by, "node_id").agg(F.sum("delta").alias("delta"))
    return nodes.join(delta, [*by, "node_id"], "left").withColumn(
        "cn_smooth", (F.col("cn") + F.coalesce("delta", F.lit(0))).cast("long")
    ).drop("delta")


def repeated_junctions(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Junction pairs listed more than once (an inconsistency in a pairing)."""
    return (
        edges.groupBy(*by, "n1", "n1_side", "n2", "n2_side").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    )


def paste_junctions(nodes: DataFrame, edges: DataFrame, junctions: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Graphs with paired loose ends joined: ``(edges, loose)``.

    ``junctions`` is ``(by, a, b, cn)`` over ends numbered ``2 * node`` (left) and ``2 * node + 1`` (right), as from the pairing
    of loose ends; ``a = b`` folds an end back, which takes two of its copies.  They become ``ALT`` edges, or add to an edge
    between the same ends.  ``loose`` holds what no junction takes up now: ``(by, node_id, orientation, node_cn, cn)``, cn > 0.
    """
    end = lambda c: F.struct(F.floor(F.col(c) / 2).cast("int").alias("n"), F.when(F.col(c) % 2 == 0, "left").otherwise("right").alias("side"))
    lo, hi = F.least(end("a"), end("b")), F.greatest(end("a"), end("b"))
    new = junctions.select(*by, lo.alias("_lo"), hi.alias("_hi"), "cn").select(
        *by, F.col("_lo.n").alias("n1"), F.col("_lo.side").alias("n1_side"), F.col("_hi.n").alias("n2"), F.col("_hi.side").alias("n2_side"),
        "cn", F.lit("ALT").alias("type"))
    ends = ["n1", "n1_side", "n2", "n2_side"]
    whole = edges.filter("type <> 'LOO'").select(*by, *ends, "cn", "type").unionByName(new).groupBy(*by, *ends).agg(
        F.sum("cn").alias("cn"), F.max("type").alias("type"))
    return whole, loose_ends(nodes, whole, by).filter("cn > 0")

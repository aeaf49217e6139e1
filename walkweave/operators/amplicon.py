"""Amplicon structure: entropy over walks, scoring and peeling of circular walks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkweave.operators.canonical import KEY, list_keys, walk_keys
from walkweave.operators.graph import count_junctions, graph_external, largest_wiring, subids, wiring, with_next
from walkweave.operators.intervals import overlap_semi
from walkweave.operators.sampling import sample_walks
from walkweave.operators.traversal import list_steps
from walkweave.session import cut


def amplicon_entropy(steps: DataFrame, amplicon: DataFrame, by: Sequence[str] = ("kar_id",), walk: Sequence[str] = ("walk_id",)) -> DataFrame:
    """Shannon entropy of the amplicon's node copies over the walks of a karyotype: ``(by, entropy)``."""
    inside = steps.withColumn("node_id", F.abs("node")).join(amplicon.select("node_id"), "node_id", "left_semi")
    per_walk = inside.groupBy(*by, *walk).agg(F.count(F.lit(1)).cast("double").alias("c"))
    # -sum(f ln f) with f = c / t is ln t - sum(c ln c) / t: one more aggregation, no join back
    return per_walk.groupBy(*by).agg(
        (F.ln(F.sum("c")) - F.sum(F.col("c") * F.ln("c")) / F.sum("c")).alias("entropy"))


def lowest_entropy(entropies: DataFrame, k: int, group: str = "gid", kar: str = "kar_id") -> DataFrame:
    """The k karyotypes of least entropy per graph (k is the report size)."""
    w = Window.partitionBy(group).orderBy("entropy", kar)
    return entropies.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def frozen_nodes(nodes: DataFrame, amplicon: DataFrame, margin: int = 1000) -> DataFrame:
    """Nodes further than ``margin`` from every amplicon range (few ranges; nodes are genome-sized)."""
    near = amplicon.select("seqnames", (F.col("start") - margin).alias("_s"), (F.col("end") + margin).alias("_e"))
    close = nodes.join(near, "seqnames").filter((F.col("start") <= F.col("_e")) & (F.col("_s") <= F.col("end"))).select("node_id").distinct()
    return nodes.join(close, "node_id", "left_anti").select("node_id")


def score_rings(rings: DataFrame, nodes: DataFrame, edges: DataFrame, widths: DataFrame, amplicon: DataFrame,
                by: Sequence[str] = ("gid",), block: int | None = None) -> DataFrame:
    """Score circular walks by how much of the amplicon they explain.

    ``(by, walk_id, max_cn, ampfrac, score)``: ``max_cn`` copies of the walk fit into the graph,
    ``ampfrac`` is the amplicon copy mass they account for, ``score`` their product.  ``nodes`` and
    ``edges`` carry the graph's copy numbers, keyed by ``by``.
    """
    keys = [*by, "walk_id"]
    amp = amplicon.select("node_id", F.lit(1).alias("_amp")).distinct()
    visits = rings.groupBy(*keys, F.abs("node").alias("node_id")).agg(F.count(F.lit(1)).alias("m"))
    at_nodes = visits.join(nodes.select(*by, "node_id", F.col("cn").alias("_cn")), [*by, "node_id"], "left").join(
        widths.select("node_id", "width"), "node_id").join(amp, "node_id", "left")
    room = F.floor(F.coalesce("_cn", F.lit(0)) / F.col("m"))
    node_fit = at_nodes.groupBy(*keys).agg(
        F.min(room).alias("_n"), F.sum(F.col("width") * F.col("m") * F.coalesce("_amp", F.lit(0))).alias("_mass"),
        F.max("_amp").alias("_hit"))
    hops = count_junctions(with_next(rings, 2, keys, **({"block": block} if block else {})).filter("nx1 IS NOT NULL"), keys, None)
    ends = ["n1", "n1_side", "n2", "n2_side"]
    at_edges = hops.select(*keys, *ends, F.col("cn").alias("m")).join(
        edges.select(*by, *ends, F.col("cn").alias("_cn")), [*by, *ends], "left")
    edge_fit = at_edges.groupBy(*keys).agg(F.min(F.floor(F.coalesce("_cn", F.lit(0)) / F.col("m"))).alias("_e"))
    weight = nodes.join(amp.select("node_id"), "node_id", "left_semi").join(widths.select("node_id", "width"), "node_id").groupBy(
        *by).agg(F.sum(F.col("cn") * F.col("width")).alias("_weight"))
    fit = node_fit.filter("_hit = 1").join(edge_fit, keys).join(weight, list(by)).withColumn("max_cn", F.least("_n", "_e"))
    frac = F.col("max_cn") * F.col("_mass") / F.col("_weight")
    return fit.select(*keys, F.col("max_cn").cast("long").alias("max_cn"), frac.alias("ampfrac"), (F.col("max_cn") * frac).alias("score"))


def ranked_rings(scores: DataFrame, k: int) -> DataFrame:
    """The k best rings of every graph that fit into it: ``(gid, walk_id, max_cn, score, rank)``."""
    w = Window.partitionBy("gid").orderBy(F.col("score").desc(), "walk_id")
    return scores.filter("max_cn > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def peel(scores: DataFrame, rings: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 1, seed: int = 1, upto: bool = False) -> DataFrame:
    """Karyotypes built around the k-th best ring of every graph: ``(gid, walk_id, circular, pos, n, node, cn)``.

    The ring's copies leave the graph, one karyotype is sampled from what remains, and the ring is
    added back with its copy number.  With ``upto`` all of the k best rings are taken, each out of its own
    copy of the graph, and the result has their ``rank``.
    """
    best = ranked_rings(scores, k)
    best = (best if upto else best.filter(F.col("rank") == k)).select("gid", "walk_id", "max_cn", "rank")
    # one graph for every ring that is taken out
    each = F.col("gid") * k + F.col("rank") - 1
    chosen = cut(rings.join(best, ["gid", "walk_id"]).withColumn("_g", each))
    own = best.select("gid", each.alias("_g"))
    gone = chosen.groupBy("_g", F.abs("node").alias("node_id")).agg(F.sum("max_cn").alias("_sub"))
    left_nodes = nodes.join(own, "gid").join(gone, ["_g", "node_id"], "left").withColumn("cn", F.col("cn") - F.coalesce("_sub", F.lit(0))).filter(
        "cn > 0").drop("_sub", "gid").withColumnRenamed("_g", "gid")
    ends = ["n1", "n1_side", "n2", "n2_side"]
    hops = count_junctions(with_next(chosen, 2, ["_g", "walk_id"]).filter("nx1 IS NOT NULL"), ["_g", "max_cn"], None)
    used = hops.select("_g", *ends, (F.col("cn") * F.col("max_cn")).alias("_sub"))
    left_edges = edges.filter("type <> 'LOO'").join(own, "gid").join(used, ["_g", *ends], "left").withColumn(
        "cn", F.col("cn") - F.coalesce("_sub", F.lit(0))).filter("cn > 0").drop("_sub", "gid").withColumnRenamed("_g", "gid")
    ext = cut(subids(graph_external(left_nodes, left_edges, ["gid"], deal=True), ["gid"]))
    rest, largest = wiring(ext, ["gid"], deal=True), largest_wiring(ext, ["gid"])
    at = [F.floor(F.col("gid") / k).alias("gid"), (F.pmod(F.col("gid"), F.lit(k)) + 1).cast("int").alias("rank")]
    others = sample_walks(rest, 1, seed, unique=False, largest=largest, dealt=True).select(
        *at, F.col("walk_id").cast("long").alias("walk_id"), "circular", "pos", "n", "node", F.lit(1).cast("long").alias("cn"))
    rings_back = chosen.select("gid", F.col("rank").cast("int").alias("rank"), (-F.col("walk_id") - 1).cast("long").alias("walk_id"), "circular", "pos", "n", "node",
                               F.col("max_cn").alias("cn"))
    out = others.unionByName(rings_back)
    return out if upto else out.drop("rank")


def boil_rings(wiring_rows: DataFrame, nodes: DataFrame, edges: DataFrame, genome: DataFrame, amplicon: DataFrame, samples: int, seed: int = 1,
               margin: int = 1000, split: bool = False, largest: int | None = None, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct circular walks over an amplicon in ``samples`` karyotypes of every graph, and their scores: ``(rings, scores)``.

    ``amplicon`` holds ranges.  Nodes further than ``margin`` from it are frozen, so the samples differ around the amplicon only.
    """
    inside = overlap_semi(genome, amplicon, 1 << 20, "node_id").select("node_id")
    steps = sample_walks(wiring_rows, samples, seed, frozen_nodes(genome, amplicon, margin), unique=False, split=split, largest=largest,
                         lists=True, dealt=dealt).filter("circular")
    steps = cut(steps.withColumn("walk_id", F.struct("kar_id", "walk_id")).drop("kar_id"))
    lists = "nodes" in steps.columns
    keys = (list_keys if lists else walk_keys)(steps, ("gid", "walk_id"), largest)
    first = keys.groupBy("gid", *KEY).agg(F.min("walk_id").alias("walk_id")).select("gid", "walk_id")
    number = F.row_number().over(Window.partitionBy("gid").orderBy("walk_id")) - 1
    first = first.withColumn("_id", number.cast("long"))
    rings = steps.join(first, ["gid", "walk_id"]).drop("walk_id").withColumnRenamed("_id", "walk_id")
    rings = cut(list_steps(rings) if lists else rings)
    return rings, score_rings(rings, nodes, edges, genome, inside)


def boil(wiring_rows: DataFrame, nodes: DataFrame, edges: DataFrame, genome: DataFrame, amplicon: DataFrame, samples: int, k: int = 1, seed: int = 1,
         margin: int = 1000, split: bool = False, largest: int | None = None) -> DataFrame:
    """Karyotypes around the k best rings over the amplicon: as ``peel``, with ``rank``."""
    rings, scores = boil_rings(wiring_rows, nodes, edges, genome, amplicon, samples, seed, margin, split, largest)
    return peel(cut(scores), rings.select("gid", "walk_id", "circular", "pos", "n", "node"), nodes, edges, k, seed, upto=True)


def squeeze(wiring_rows: DataFrame, genome: DataFrame, amplicon: DataFrame, samples: int, k: int = 1, seed: int = 1, margin: int = 1000,
            split: bool = False, largest: int | None = None, dealt: bool = False) -> DataFrame:
    """The k sampled karyotypes of every graph that spread the amplicon least over their walks: ``(gid, kar_id, entropy, rank)``.

    ``amplicon`` holds ranges.  Nodes further than ``margin`` from it are frozen.
    """
    inside = overlap_semi(genome, amplicon, 1 << 20, "node_id").select("node_id")
    steps = sample_walks(wiring_rows, samples, seed, frozen_nodes(genome, amplicon, margin), unique=False, split=split, largest=largest, dealt=dealt)
    return lowest_entropy(amplicon_entropy(steps, inside, ["gid", "kar_id"]).withColumn("entropy", F.round("entropy", 9)), k)

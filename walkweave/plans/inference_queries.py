"""Registered queries for fitting, optimiser tables, collapse, amplicons and loose-end pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from walkweave.functions.rand import sql_uniform
from walkweave.operators import amplicon as A
from walkweave.operators import collapse as CO
from walkweave.operators import graph as G
from walkweave.operators import inference as INF
from walkweave.operators import intervals as I
from walkweave.operators import pairing as P
from walkweave.operators import sampling as S
from walkweave.operators.skew import heavy_keys
from walkweave.operators.traversal import traverse
from walkweave.plans import tables as T
from walkweave.plans.contact_queries import BIN, HALVES, NODE_TILES, PIX, WINDOWS, _node_tiles, genome_windows, placed_sql, rebin_sql
from walkweave.plans.distance_queries import _pixels
from walkweave.plans.graph_queries import (
    CHR, CUSTOMER_STEPS, EXTERNAL, NXT, SAMPLED_KARS, SAMPLES, WIRING, _bounded_wiring, _edges, _external, _gid_wiring, walked,
)
from walkweave.plans.oracle import CONTACTS, GENOME, ORDER_STEPS
from walkweave.plans.pipelines import neighbor_separable
from walkweave.session import cut
from walkweave.sources.calibration import INTERCHROM_DENSITY

DEPTH = 4
AREA0 = 1e8
#: Starting karyotypes of a graph and neighbours of each.
STARTS, NEIGHBORS = 2, 2
MIN_WIDTH = 40_000


def _half_contacts(spark, sf):
    half = I.half_nodes(T.genome(spark, sf))
    return I.rebin(T.contacts(spark, sf), _node_tiles(spark, sf), half, BIN), half


def _scores(spark, sf, legacy=False):
    observed, half = _half_contacts(spark, sf)
    return INF.score_candidates(_pixels(spark, sf), cut(observed), half, DEPTH, area0=AREA0, legacy=legacy,
                                candidates=T.order_walks(spark, sf).df.select("kar_id"))


def walk_scores(spark, sf):
    return _scores(spark, sf).withColumn("nll", F.round("nll", 1))


def walk_scores_legacy(spark, sf):
    return _scores(spark, sf, legacy=True).withColumn("nll", F.round("nll", 1))


def best_fits(spark, sf):
    return INF.best_fits(cut(_scores(spark, sf).withColumn("nll", F.round("nll", 1))), 10)


def fit_gaps(spark, sf):
    """Orders of a priority class ranked by score, with the gap to the next one."""
    orders = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("kar_id"), "o_custkey", "o_orderpriority")
    scores = _scores(spark, sf).withColumn("nll", F.round("nll", 1)).join(orders, "kar_id")
    hot = heavy_keys(orders.select("o_custkey"), "o_custkey")
    ranked = INF.rank_table(scores, "o_custkey", F.col("o_orderpriority") == "1-URGENT", hot)
    return ranked.select("o_custkey", "kar_id", "nll", F.col("rank").cast("int").alias("rank"), F.round("gap", 1).alias("gap"), "is_truth")


def _copies(spark, sf):
    steps = T.customer_walks(spark, sf).df
    nodes = T.genome(spark, sf).drop("cn").join(G.walk_nodes(steps), "node_id")
    return cut(nodes), steps


def export_nodes(spark, sf):
    return INF.half_node_copies(_copies(spark, sf)[0]).select("unique_id", "node_id", "side", "width")


def export_tile_copies(spark, sf):
    nodes, _ = _copies(spark, sf)
    return INF.export_tile_copies(INF.export_tiles(nodes, PIX, BIN), INF.half_node_spans(nodes))


def export_internal_edges(spark, sf):
    return INF.export_internal_edges(INF.half_node_spans(_copies(spark, sf)[0]))


def export_external_edges(spark, sf):
    nodes, steps = _copies(spark, sf)
    return INF.export_external_edges(G.walk_edges(steps, [], CHR), INF.half_node_spans(nodes))


def band_rows(spark, sf):
    return CO.band_rows(T.genome(spark, sf), genome_windows(spark, sf), BIN)


def _collapsed(spark, sf):
    walks = T.customer_walks(spark, sf)
    rows = band_rows(spark, sf).select("row_id", "node_id", "seqnames", "width")
    return CO.collapse_walks(walks.df, rows, MIN_WIDTH, ["walk_id"], split=walks.split), walks.split


def collapsed_walks(spark, sf):
    return _collapsed(spark, sf)[0].select("walk_id", "pos", "row_out")


def collapsed_classes(spark, sf):
    """How many walks collapse to the same rows, and the first of them."""
    rows, split = _collapsed(spark, sf)
    return CO.collapsed_keys(rows, split=split).groupBy("len", "h1", "h2").agg(
        F.min("walk_id").alias("walk_id"), F.count(F.lit(1)).alias("walks")).select("walk_id", "walks")


def _amplicon(spark, sf):
    return T.genome(spark, sf).filter("seqnames IN ('chr1', 'chr2', 'chr3')").select("node_id")


def amplicon_entropy(spark, sf):
    steps = T.customer_walks(spark, sf).df
    return A.amplicon_entropy(steps, _amplicon(spark, sf)).withColumn("entropy", F.round("entropy", 9))


def squeezed(spark, sf):
    """Per graph the sampled karyotype whose amplicon copies are spread least."""
    w, split, largest = _bounded_wiring(spark, sf)
    steps = S.sample_walks(w, SAMPLES, seed=7, unique=False, split=split, largest=largest, dealt=not split)
    entropies = A.amplicon_entropy(steps, _amplicon(spark, sf), ["gid", "kar_id"]).withColumn("entropy", F.round("entropy", 9))
    best = A.lowest_entropy(entropies, 1)
    return best.select("gid", (F.col("kar_id") % SAMPLES).cast("int").alias("sample"), "entropy")


def _rings(spark, sf):
    ext, split = _external(spark, sf)
    w = G.wiring(ext, ["kar_id"], split, deal=True).withColumnRenamed("kar_id", "gid")
    rings = cut(traverse(w, largest=G.largest_wiring(ext, ["kar_id"]), dealt=not split).filter("circular").select("gid", F.col("walk").alias("walk_id"), "circular", "pos", "n", "node"))
    edges = ext.withColumnRenamed("kar_id", "gid")
    nodes = cut(w.groupBy("gid", F.col("n").alias("node_id")).agg(F.count(F.lit(1)).alias("cn")))
    return rings, nodes, edges


def ring_scores(spark, sf):
    rings, nodes, edges = _rings(spark, sf)
    scores = A.score_rings(rings, nodes, edges, T.genome(spark, sf), _amplicon(spark, sf))
    return scores.select("gid", "walk_id", "max_cn", F.round("ampfrac", 9).alias("ampfrac"), F.round("score", 9).alias("score"))


def peeled(spark, sf):
    """Copies per node of the karyotypes built around the best ring: the graph's own copies again."""
    rings, nodes, edges = _rings(spark, sf)
    scores = cut(A.score_rings(rings, nodes, edges, T.genome(spark, sf), _amplicon(spark, sf)))
    out = A.peel(scores, rings, nodes, edges, seed=3)
    return out.groupBy("gid", F.abs("node").alias("node_id")).agg(F.sum("cn").alias("copies"))


def _loose_ends(graphs):
    end = F.when(F.col("n1") == 0, F.col("n2") * 2).otherwise(F.col("n1") * 2 + 1)
    return graphs.filter("type = 'LOO'").select("gid", end.cast("long").alias("end_id"), "cn")


def _loose(spark, sf):
    ext, _ = _external(spark, sf)
    return _loose_ends(ext.withColumnRenamed("kar_id", "gid"))


def loose_pairing(spark, sf):
    """Copies of every loose end that the junctions use up (a fold-back takes two a copy)."""
    found = P.pair_loose_ends(_loose(spark, sf), seed=5)
    ends = found.select("gid", F.explode(F.array("a", "b")).alias("end_id"), "cn")
    return ends.groupBy("gid", "end_id").agg(F.sum("cn").alias("copies"))


def loose_junctions(spark, sf):
    return P.pair_loose_ends(_loose(spark, sf), seed=5)


def pasted_graphs(spark, sf):
    """Graphs whose loose ends were joined: number of junctions, their copies, and the loose copies that stay (none or one)."""
    walks = T.customer_walks(spark, sf)
    graphs = cut(G.walk_external(walks.df, ["kar_id"], CHR).withColumnRenamed("kar_id", "gid"))
    ends = _loose_ends(graphs)
    found = cut(P.pair_loose_ends(ends, seed=5, split=P.many_ends(ends)))
    edges, loose = G.paste_junctions(G.external_nodes(graphs, ["gid"]), graphs, found, ["gid"])
    # what every graph, junction, edge before and after, and loose end adds to the counts of its graph
    zero = F.lit(0).cast("long")
    part = lambda df, junctions=zero, copies=zero, loose=zero: df.select(
        "gid", junctions.cast("long").alias("junctions"), copies.cast("long").alias("copies"), loose.cast("long").alias("loose"))
    before = part(graphs, copies=F.when(F.col("type") == "LOO", 0).otherwise(-F.col("cn")))
    parts = before.unionByName(part(found, junctions=F.lit(1))).unionByName(part(edges, copies=F.col("cn"))).unionByName(part(loose, loose=F.col("cn")))
    return parts.groupBy("gid").agg(*[F.sum(c).alias(c) for c in ("junctions", "copies", "loose")])


def neighbor_separability(spark, sf):
    w, _ = _gid_wiring(spark, sf)
    out = neighbor_separable(w, T.genome(spark, sf), STARTS, NEIGHBORS, (-30_000, 50_000), seed=21)
    return out.withColumn("separable", F.round("separable", 6))


# ---- oracle text -------------------------------------------------------------------------------

OBS = f"""{HALVES}, {NODE_TILES}, {CONTACTS}, {rebin_sql('ntiles', 'halves', 'contacts', 'obs')}"""
NLL = "(-area / {a}::DOUBLE * CASE WHEN {mu} = 0 THEN 0 ELSE ln({x} + 1) + 2 * ln(2 / (2 + {mu})) + {x} * ln({mu} / (2 + {mu})) END)"


def _nll(x: str, mu: str, legacy: bool) -> str:
    if legacy:
        x, mu = mu, x
    return NLL.format(a=repr(AREA0), x=f"round_even({x}, 0)", mu=mu)


def _scored(legacy: bool) -> str:
    px = ("(x.e - x.s + 1)::DOUBLE * (y.e - y.s + 1) AS area, (x.e - x.s + 1)::DOUBLE * (y.e - y.s + 1) * "
          f"{INTERCHROM_DENSITY!r}::DOUBLE * (x.cn * y.cn) * {DEPTH / 2!r}::DOUBLE AS base")
    return f"""WITH {GENOME}, {OBS}, {ORDER_STEPS}, {placed_sql('halves', by='kar_id,')},
grid AS (SELECT x.tile_id AS i, y.tile_id AS j, {px} FROM halves x JOIN halves y ON x.tile_id <= y.tile_id),
g2 AS (SELECT grid.*, coalesce(o.value, 0) AS x FROM grid LEFT JOIN obs o ON o.i = grid.i AND o.j = grid.j),
tot AS (SELECT sum({_nll('x', 'base', legacy)}) AS t FROM g2),
own AS (SELECT kar_id, area, base, x, base + v * {DEPTH / 2!r}::DOUBLE AS mu FROM intra JOIN g2 ON g2.i = intra.i AND g2.j = intra.j),
gains AS (SELECT kar_id, sum({_nll('x', 'mu', legacy)} - {_nll('x', 'base', legacy)}) AS g FROM own GROUP BY kar_id),
scores AS (
  SELECT kar_id, round((SELECT t FROM tot) + coalesce(g, 0), 1) AS nll FROM (SELECT DISTINCT kar_id FROM steps) LEFT JOIN gains USING (kar_id))"""


HCOPIES = f"""
ncn AS (SELECT g.node_id, g.seqnames, g.s, g.e, g.width, c.cn FROM genome g JOIN (SELECT abs(node) AS node_id, count(*) AS cn FROM steps GROUP BY 1) c USING (node_id)),
{HALVES.replace('FROM genome', 'FROM ncn')},
hc AS (
  SELECT *, row_number() OVER (ORDER BY tile_id, occ) AS unique_id FROM (
    SELECT tile_id, node_id, side, seqnames, s, e, unnest(range(1, cn + 1)) AS occ FROM halves))"""

BANDS = f"""{WINDOWS},
brow AS (
  SELECT CAST(row_number() OVER (ORDER BY node_id, greatest(g.s, w.s)) AS INTEGER) AS row_id, node_id, w.tile_id AS band_id, g.seqnames,
         greatest(g.s, w.s) AS s, least(g.e, w.e) AS e, least(g.e, w.e) - greatest(g.s, w.s) + 1 AS width
  FROM genome g JOIN wins w ON g.seqnames = w.seqnames AND g.s <= w.e AND w.s <= g.e)"""

COLLAPSED = f"""{BANDS},
rows0 AS (
  SELECT walk_id, pos, CASE WHEN node > 0 THEN row_id ELSE -row_id END AS r, seqnames, width
  FROM steps JOIN brow ON brow.node_id = abs(node)),
rows1 AS (
  SELECT *, row_number() OVER w AS k, CASE WHEN lag(r) OVER w = r - 1 AND lag(seqnames) OVER w = seqnames THEN 0 ELSE 1 END AS brk
  FROM rows0 WINDOW w AS (PARTITION BY walk_id ORDER BY pos, r)),
rows2 AS (SELECT *, sum(brk) OVER (PARTITION BY walk_id ORDER BY k) AS run FROM rows1),
rows3 AS (SELECT *, sum(width) OVER (PARTITION BY walk_id, run) < {MIN_WIDTH} AS small FROM rows2),
rows4 AS (SELECT *, CASE WHEN lag(small) OVER (PARTITION BY walk_id ORDER BY k) = small THEN 0 ELSE 1 END AS gb FROM rows3),
rows5 AS (SELECT *, sum(gb) OVER (PARTITION BY walk_id ORDER BY k) AS g FROM rows4),
rows6 AS (SELECT *, NOT small OR sum(width) OVER (PARTITION BY walk_id, g) > {MIN_WIDTH} AS keep FROM rows5),
outp AS (
  SELECT walk_id, k, CASE WHEN small THEN 'NA' ELSE r::VARCHAR END AS o, small AND lag(g) OVER (PARTITION BY walk_id ORDER BY k) = g AS dup
  FROM rows6 WHERE keep),
coll AS (
  SELECT walk_id, coalesce(bands, '') AS bands FROM (SELECT DISTINCT walk_id FROM steps) LEFT JOIN (
    SELECT walk_id, string_agg(o, '|' ORDER BY k) AS bands FROM outp WHERE NOT coalesce(dup, false) GROUP BY walk_id) USING (walk_id))"""

AMP = "amp AS (SELECT node_id FROM genome WHERE seqnames IN ('chr1', 'chr2', 'chr3'))"

RINGS = f"""WITH RECURSIVE {GENOME}, {CUSTOMER_STEPS}, {NXT}, {WIRING}, {walked('wiring')}, {AMP},
rk AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY gid ORDER BY circular, head) - 1 AS INTEGER) AS walk_id FROM walked),
ring AS (SELECT gid, walk_id, pos, node, lead(node) OVER w AS nx, first_value(node) OVER w AS f FROM rk WHERE circular WINDOW w AS (PARTITION BY gid, walk_id ORDER BY pos)),
vis AS (SELECT gid, walk_id, abs(node) AS node_id, count(*) AS m FROM ring GROUP BY ALL),
nfit AS (
  SELECT v.gid, v.walk_id, min(n.cn // m) AS c, sum(g.width * m) FILTER (v.node_id IN (FROM amp)) AS mass
  FROM vis v JOIN nodes n ON n.kar_id = v.gid AND n.node_id = v.node_id JOIN genome g ON g.node_id = v.node_id GROUP BY ALL),
he AS (
  SELECT gid, walk_id, abs(node) AS an, CASE WHEN node > 0 THEN 'right' ELSE 'left' END AS aside,
         abs(coalesce(nx, f)) AS bn, CASE WHEN coalesce(nx, f) > 0 THEN 'left' ELSE 'right' END AS bside FROM ring),
je AS (
  SELECT gid, walk_id, least((an, aside), (bn, bside)) AS lo, greatest((an, aside), (bn, bside)) AS hi, count(*) AS m FROM he GROUP BY ALL),
efit AS (
  SELECT j.gid, j.walk_id, min(e.cn // m) AS c FROM je j
  JOIN edges e ON e.kar_id = j.gid AND (e.n1, e.n1_side) = j.lo AND (e.n2, e.n2_side) = j.hi GROUP BY ALL),
wt AS (SELECT kar_id AS gid, sum(nodes.cn * g.width) AS w FROM nodes JOIN genome g USING (node_id) WHERE node_id IN (FROM amp) GROUP BY kar_id),
rs AS (
  SELECT n.gid, n.walk_id, CAST(least(n.c, e.c) AS BIGINT) AS max_cn, least(n.c, e.c) * mass / w AS ampfrac
  FROM nfit n JOIN efit e USING (gid, walk_id) JOIN wt USING (gid) WHERE mass IS NOT NULL)"""

#: Loose ends with one copy drawn away where a graph has an odd number of them.
TRIMMED = f"""WITH RECURSIVE {CUSTOMER_STEPS}, {NXT}, {EXTERNAL},
        le AS (SELECT kar_id AS gid, CAST(CASE WHEN n1 = 0 THEN n2 * 2 ELSE n1 * 2 + 1 END AS BIGINT) AS end_id, cn FROM ext WHERE type = 'LOO'),
        lu AS (SELECT *, 1 - pow(1 - {sql_uniform(5, 'gid', 'end_id')}, 1.0::DOUBLE / cn) AS u FROM le),
        lo AS (SELECT gid, sum(cn) % 2 AS odd, arg_min(end_id, (u, end_id)) AS gone FROM lu GROUP BY gid),
        trimmed AS (
          SELECT gid, end_id, CAST(cn - CASE WHEN odd = 1 AND end_id = gone THEN 1 ELSE 0 END AS BIGINT) AS cn
          FROM le JOIN lo USING (gid) WHERE cn - CASE WHEN odd = 1 AND end_id = gone THEN 1 ELSE 0 END > 0)"""

QUERIES = {
    "walk_scores": (walk_scores, f"{_scored(False)} SELECT kar_id, nll FROM scores"),
    "walk_scores_legacy": (walk_scores_legacy, f"{_scored(True)} SELECT kar_id, nll FROM scores"),
    "best_fits": (best_fits, f"""{_scored(False)}
        SELECT kar_id, nll, CAST(rank AS INTEGER) AS rank FROM (SELECT *, rank() OVER (ORDER BY nll) AS rank FROM scores) WHERE rank <= 10"""),
    "fit_gaps": (fit_gaps, f"""{_scored(False)}
        SELECT o_custkey, kar_id, nll, CAST(row_number() OVER w AS INTEGER) AS rank, round(lead(nll) OVER w - nll, 1) AS gap,
               o_orderpriority = '1-URGENT' AS is_truth
        FROM scores JOIN orders ON o_orderkey = kar_id WINDOW w AS (PARTITION BY o_custkey ORDER BY nll, kar_id)"""),
    "export_nodes": (export_nodes, f"WITH {GENOME}, {CUSTOMER_STEPS}, {HCOPIES} SELECT unique_id, node_id, side, e - s + 1 AS width FROM hc"),
    "export_tile_copies": (export_tile_copies, f"""WITH {GENOME}, {CUSTOMER_STEPS}, {HCOPIES},
        wn AS (SELECT seqnames, rs + k * {PIX} AS s, rs + k * {PIX} + {PIX - 1} AS e FROM (
          SELECT seqnames, rs, unnest(range((re - rs) // {PIX} + 1)) AS k FROM (SELECT seqnames, min(s) AS rs, max(e) AS re FROM genome GROUP BY seqnames))),
        tl AS (
          SELECT CAST(row_number() OVER (ORDER BY h.seqnames, greatest(h.s, w.s)) AS INTEGER) AS tile_id, h.tile_id AS half,
                 greatest(h.s, w.s) AS s, least(h.e, w.e) AS e, h.s AS hs, h.e AS he
          FROM halves h JOIN wn w ON h.seqnames = w.seqnames AND h.s <= w.e AND w.s <= h.e)
        SELECT t.e - t.s + 1 AS width, unique_id, t.tile_id, t.s - hs + (t.e - t.s + 1)::DOUBLE / 2 AS leftdist,
               he - t.e + (t.e - t.s + 1)::DOUBLE / 2 AS rightdist
        FROM tl t JOIN hc ON hc.tile_id = t.half"""),
    "export_internal_edges": (export_internal_edges, f"""WITH {GENOME}, {CUSTOMER_STEPS}, {HCOPIES}
        SELECT l.node_id, l.unique_id AS "left", r.unique_id AS "right", count(*) OVER (PARTITION BY l.node_id) AS copies
        FROM hc l JOIN hc r ON l.node_id = r.node_id AND l.occ = r.occ WHERE l.side = 'left' AND r.side = 'right'"""),
    "export_external_edges": (export_external_edges, f"""WITH {GENOME}, {CUSTOMER_STEPS}, {NXT}, {_edges('')}, {HCOPIES},
        ec AS (SELECT *, row_number() OVER (ORDER BY n1, n1_side, n2, n2_side) AS edge_id FROM (SELECT edges.*, unnest(range(cn)) AS k FROM edges)),
        en AS (SELECT edge_id, 1 AS role, n1 AS node_id, n1_side AS side FROM ec UNION ALL SELECT edge_id, 2, n2, n2_side FROM ec),
        eo AS (SELECT *, row_number() OVER (PARTITION BY node_id, side ORDER BY role, edge_id) AS occ FROM en),
        ep AS (SELECT edge_id, role, unique_id FROM eo LEFT JOIN hc USING (node_id, side, occ))
        SELECT edge_id, max(unique_id) FILTER (role = 1) AS n1, max(unique_id) FILTER (role = 2) AS n2 FROM ep GROUP BY edge_id"""),
    "band_rows": (band_rows, f"""WITH {GENOME}, {BANDS} SELECT row_id, node_id, band_id, seqnames, s AS "start", e AS "end", width FROM brow"""),
    "collapsed_walks": (collapsed_walks, f"WITH {GENOME}, {CUSTOMER_STEPS}, {COLLAPSED} SELECT walk_id, k AS pos, CAST(nullif(o, 'NA') AS INTEGER) AS row_out FROM outp WHERE NOT coalesce(dup, false) UNION ALL SELECT walk_id, 0, NULL FROM coll WHERE bands = ''"),
    "collapsed_classes": (collapsed_classes, f"""WITH {GENOME}, {CUSTOMER_STEPS}, {COLLAPSED}
        SELECT count(*) AS walks, min(walk_id) AS walk_id FROM coll GROUP BY bands"""),
    "amplicon_entropy": (amplicon_entropy, f"""WITH {GENOME}, {CUSTOMER_STEPS}, {AMP},
        c AS (SELECT kar_id, walk_id, count(*)::DOUBLE AS c FROM steps WHERE abs(node) IN (FROM amp) GROUP BY ALL),
        f AS (SELECT kar_id, c / sum(c) OVER (PARTITION BY kar_id) AS f FROM c)
        SELECT kar_id, abs(round(-sum(f * ln(f)), 9)) AS entropy FROM f GROUP BY kar_id"""),
    "squeezed": (squeezed, f"""WITH RECURSIVE {GENOME}, {CUSTOMER_STEPS}, {NXT}, {WIRING}, {SAMPLED_KARS}, {AMP},
        c AS (SELECT kar_id, walk_id, count(*)::DOUBLE AS c FROM wsteps WHERE abs(node) IN (FROM amp) GROUP BY ALL),
        f AS (SELECT kar_id, c / sum(c) OVER (PARTITION BY kar_id) AS f FROM c),
        en AS (SELECT kar_id // {SAMPLES} AS gid, kar_id % {SAMPLES} AS sample, abs(round(-sum(f * ln(f)), 9)) AS entropy FROM f GROUP BY kar_id),
        rn AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY entropy, sample) AS r FROM en)
        SELECT gid, CAST(sample AS INTEGER) AS sample, entropy FROM rn WHERE r = 1"""),
    "ring_scores": (ring_scores, f"""{RINGS}
        SELECT gid, walk_id, max_cn, round(ampfrac, 9) AS ampfrac, round(max_cn * ampfrac, 9) AS score FROM rs"""),
    "peeled": (peeled, f"""{RINGS}
        SELECT kar_id AS gid, node_id, cn AS copies FROM nodes WHERE kar_id IN (SELECT gid FROM rs WHERE max_cn > 0)"""),
    "loose_pairing": (loose_pairing, f"{TRIMMED} SELECT gid, end_id, cn AS copies FROM trimmed"),
    "loose_junctions": (loose_junctions, None),
    "pasted_graphs": (pasted_graphs, f"""{TRIMMED},
        same AS (SELECT gid, cn, count(*) AS k FROM trimmed GROUP BY ALL),
        rest AS (SELECT gid, cn, row_number() OVER (PARTITION BY gid ORDER BY cn) AS i, count(*) OVER (PARTITION BY gid) AS m FROM same WHERE k % 2 = 1),
        -- every number in neither set, or on one side of the first or the second
        part AS (
          SELECT DISTINCT gid, m, 0::BIGINT AS i, 0::BIGINT AS x, 0::BIGINT AS y, 0 AS nx, 0 AS ny FROM rest
          UNION
          SELECT p.gid, p.m, r.i, x + a * r.cn, y + b * r.cn, greatest(nx, abs(a)), greatest(ny, abs(b))
          FROM part p JOIN rest r ON r.gid = p.gid AND r.i = p.i + 1 CROSS JOIN (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(a, b)),
        fam AS (SELECT gid, m, max(nx + ny) AS f FROM part WHERE i = m AND x = 0 AND y = 0 GROUP BY ALL),
        twos AS (SELECT gid, sum(k // 2) AS p, sum(k * cn) // 2 AS c FROM same GROUP BY gid)
        SELECT g.gid, CAST(coalesce(p, 0) + coalesce(m, 0) - coalesce(f, 0) AS BIGINT) AS junctions, CAST(coalesce(c, 0) AS BIGINT) AS copies,
               CAST(coalesce(odd, 0) AS BIGINT) AS loose
        FROM (SELECT DISTINCT kar_id AS gid FROM ext) g LEFT JOIN twos USING (gid) LEFT JOIN fam USING (gid) LEFT JOIN lo USING (gid)"""),
    "neighbor_separability": (neighbor_separability, None),
}

"""Registered queries over part of the genome: cut-down graphs, distances, exports and best fits within a region."""

from __future__ import annotations

from pyspark.sql import functions as F

from walkweave.functions.rand import sql_draw
from walkweave.operators import amplicon as A
from walkweave.operators import graph as G
from walkweave.operators import inference as INF
from walkweave.operators import region as RG
from walkweave.operators.collapse import EMPTY
from walkweave.plans import pipelines as PL
from walkweave.plans import tables as T
from walkweave.plans.contact_queries import BIN, NODE_TILES, PIX, REGION_TILES, _node_tiles, chromosomes, genome_windows, placed_sql, rebin_sql
from walkweave.plans.distance_queries import _hic
from walkweave.plans.graph_queries import BY, CANON, CHR, LOOSE, NXT, SAMPLED, SAMPLED_KARS, SAMPLES, WIRING, _edges
from walkweave.plans.inference_queries import AREA0, COLLAPSED, DEPTH, HCOPIES, MIN_WIDTH, _nll
from walkweave.plans.oracle import CONTACTS, CUSTOMER_STEPS, GENOME, ORDER_STEPS, PAIRS
from walkweave.session import cut
from walkweave.sources.calibration import INTERCHROM_DENSITY

FIRST, LAST = 30_001, 170_000
CHROMOSOMES = ("chr1", "chr2", "chr5")
#: Rings reported for a graph.
TOP = 3


def regions(spark, sf):
    """A stretch of three chromosomes that cuts nodes at both ends."""
    return chromosomes(T.genome(spark, sf)).filter(F.col("seqnames").isin(*CHROMOSOMES)).select(
        "seqnames", F.lit(FIRST).cast("long").alias("start"), F.lit(LAST).cast("long").alias("end"))


def _graphs(spark, sf):
    walks = T.customer_walks(spark, sf)
    steps = walks.df
    nodes = G.walk_nodes(steps, BY).join(T.genome(spark, sf).drop("cn"), "node_id")
    return cut(nodes), cut(G.walk_edges(steps, BY, CHR)), walks.hot_kar


def graph_subset(spark, sf):
    nodes, edges, split = _graphs(spark, sf)
    _, inside, loose = RG.graph_subset(nodes, edges, regions(spark, sf), BY, split=split)
    return inside.unionByName(loose)


def graph_subset_nodes(spark, sf):
    nodes, edges, split = _graphs(spark, sf)
    return RG.graph_subset(nodes, edges, regions(spark, sf), BY, split=split)[0].select("kar_id", "node_id", "source_id", "cn")


def region_group_kl(spark, sf):
    """Maps of the region at about 100 tiles, for every order and the next one of its customer."""
    walks = T.order_walks(spark, sf)
    kl = PL.group_kl(walks.df, T.genome(spark, sf), T.order_pairs(spark, sf), regions=regions(spark, sf), split=walks.split)
    return kl.select("pair_id", F.round("hic", 5).alias("hic"))


def region_pair_distances(spark, sf):
    """The same on half nodes cut at the region's borders."""
    walks = T.order_walks(spark, sf)
    out = PL.pair_distances(walks.df, T.genome(spark, sf), T.order_pairs(spark, sf), pix=0, depth=10, regions=regions(spark, sf), split=walks.split, area0=AREA0)
    return out.select("pair_id", F.round("hic", 5).alias("hic"))


def _copies(spark, sf):
    steps = T.customer_walks(spark, sf).df
    return cut(T.genome(spark, sf).drop("cn").join(G.walk_nodes(steps), "node_id")), steps


def export_region_tile_copies(spark, sf):
    nodes, _ = _copies(spark, sf)
    some = regions(spark, sf)
    return INF.export_tile_copies(INF.export_tiles(nodes, PIX, BIN, some), INF.half_node_spans(nodes, some))


def export_region_external_edges(spark, sf):
    nodes, steps = _copies(spark, sf)
    return INF.export_external_edges(G.walk_edges(steps, [], CHR), INF.half_node_spans(nodes, regions(spark, sf)))


def bestfit_search(spark, sf):
    """Per graph the sampled karyotype whose map of the region fits the observed contacts best."""
    nodes, edges, split = _graphs(spark, sf)
    genome = T.genome(spark, sf)
    fits = PL.bestfit_search(
        nodes.withColumnRenamed("kar_id", "gid").select("gid", "node_id", "cn"), edges.withColumnRenamed("kar_id", "gid"), genome,
        T.contacts(spark, sf), _node_tiles(spark, sf), SAMPLES, DEPTH, seed=7, regions=regions(spark, sf), area0=AREA0, digits=1, split=split)
    return fits.select("gid", (F.col("kar_id") % SAMPLES).cast("int").alias("sample"), "nll", F.col("rank").cast("int").alias("rank"))


def _sampled(spark, sf):
    nodes, edges, split = _graphs(spark, sf)
    return nodes.withColumnRenamed("kar_id", "gid").select("gid", "node_id", "cn"), edges.withColumnRenamed("kar_id", "gid"), split


def sampled_collapsed(spark, sf):
    """Sampled karyotypes per graph by what they collapse to: the first sample of each class and the number of karyotypes."""
    nodes, edges, split = _sampled(spark, sf)
    _, classes = PL.sample_and_collapse(nodes, edges, T.genome(spark, sf), SAMPLES, MIN_WIDTH, genome_windows(spark, sf), seed=7, bin_width=BIN, split=split)
    return classes.select("gid", (F.col("kar_id") % SAMPLES).cast("int").alias("sample"), F.col("members").alias("karyotypes"))


def _amplicon(spark, sf):
    """Ranges inside two chromosomes."""
    return regions(spark, sf).filter("seqnames <> 'chr5'")


def boiled(spark, sf):
    """Scores of the best rings over the amplicon, sampled with all nodes away from it frozen."""
    nodes, edges, split = _sampled(spark, sf)
    ext = cut(G.subids(G.graph_external(nodes, edges, ["gid"], deal=not split), ["gid"], split))
    w, largest = G.wiring(ext, ["gid"], split, deal=True), G.largest_wiring(ext, ["gid"])
    _, scores = A.boil_rings(w, nodes, edges, T.genome(spark, sf), _amplicon(spark, sf), SAMPLES, seed=7, split=split, largest=largest, dealt=not split)
    best = A.ranked_rings(scores.withColumn("score", F.round("score", 9)), TOP)
    return best.select("gid", F.col("rank").cast("int").alias("rank"), "score")


def squeezed_region(spark, sf):
    """Per graph the sampled karyotype that spreads the amplicon least, with all nodes away from it frozen."""
    nodes, edges, split = _sampled(spark, sf)
    ext = cut(G.subids(G.graph_external(nodes, edges, ["gid"], deal=not split), ["gid"], split))
    w, largest = G.wiring(ext, ["gid"], split, deal=True), G.largest_wiring(ext, ["gid"])
    best = A.squeeze(w, T.genome(spark, sf), _amplicon(spark, sf), SAMPLES, seed=7, split=split, largest=largest, dealt=not split)
    return best.select("gid", (F.col("kar_id") % SAMPLES).cast("int").alias("sample"), "entropy")


# ---- oracle text -------------------------------------------------------------------------------

WITHIN = f"seqnames IN {CHROMOSOMES} AND s <= {LAST} AND e >= {FIRST}"

SUBSET = f"""
{_edges('kar_id,')},
{LOOSE},
kept AS (
  SELECT kar_id, node_id AS source_id, CAST(row_number() OVER (PARTITION BY kar_id ORDER BY node_id) AS INTEGER) AS node_id, nodes.cn
  FROM nodes JOIN genome USING (node_id) WHERE {WITHIN}),
inside AS (
  SELECT e.kar_id, a.node_id AS n1, e.n1_side, b.node_id AS n2, e.n2_side, e.cn, e.type FROM edges e
  JOIN kept a ON a.kar_id = e.kar_id AND a.source_id = e.n1 JOIN kept b ON b.kar_id = e.kar_id AND b.source_id = e.n2),
taken AS (
  SELECT kar_id, node_id, side, sum(cn) AS used FROM (
    SELECT kar_id, n1 AS node_id, n1_side AS side, cn FROM inside UNION ALL SELECT kar_id, n2, n2_side, cn FROM inside) GROUP BY ALL),
left_over AS (
  SELECT k.kar_id, k.node_id, s.side, CAST(k.cn - coalesce(u.used, 0) AS BIGINT) AS cn
  FROM kept k CROSS JOIN (VALUES ('left'), ('right')) s(side)
  LEFT JOIN taken u ON u.kar_id = k.kar_id AND u.node_id = k.node_id AND u.side = s.side)"""

#: Half nodes of the node parts inside the region, of a node table ``{src}``.
CLIPPED = f"""
pieces AS (
  SELECT row_number() OVER (ORDER BY node_id) AS piece, node_id, seqnames, greatest(s, {FIRST}) AS s, least(e, {LAST}) AS e, cn
  FROM {{src}} WHERE {WITHIN}),
hv AS (
  SELECT CAST(piece * 2 - 1 AS INTEGER) AS tile_id, node_id, seqnames, 'left' AS side, s, s + (e - s + 1) // 2 - 1 AS e, cn FROM pieces
  UNION ALL SELECT CAST(piece * 2 AS INTEGER), node_id, seqnames, 'right', s + (e - s + 1) // 2, e, cn FROM pieces)"""

REGION_COPIES = f"""
{HCOPIES.split('halves AS')[0].rstrip().rstrip(',')},
{CLIPPED.format(src='ncn')},
hc AS (
  SELECT *, row_number() OVER (ORDER BY tile_id, occ) AS unique_id FROM (
    SELECT tile_id, node_id, side, seqnames, s, e, unnest(range(1, cn + 1)) AS occ FROM hv))"""

RESOLUTION = 1000 * round(len(CHROMOSOMES) * (LAST - FIRST + 1) / 1e5)


def _region_kl(tiles: str, area0: float) -> str:
    text = _hic("kar_id").replace("halves", tiles).replace(f"{DEPTH / 2!r}::DOUBLE", "5.0::DOUBLE")
    return text.replace(f"{AREA0!r}::DOUBLE", f"{area0!r}::DOUBLE")


def _base(part: str) -> str:
    return (f"(x.e - x.s + 1)::DOUBLE * (y.e - y.s + 1) AS area, (x.e - x.s + 1)::DOUBLE * (y.e - y.s + 1) * "
            f"{INTERCHROM_DENSITY!r}::DOUBLE * (x.cn * y.cn) * {DEPTH / 2!r}::DOUBLE AS base")


FITS = f"""WITH RECURSIVE {GENOME}, {CUSTOMER_STEPS}, {NXT}, {WIRING}, {SAMPLED_KARS}, {CLIPPED.format(src='genome')},
{NODE_TILES}, {CONTACTS}, {rebin_sql('ntiles', 'hv', 'contacts', 'obs')},
firsts AS (SELECT gid, CAST(min(sample) AS INTEGER) AS sample FROM kars GROUP BY gid, walks, circ, k),
psteps AS (
  SELECT w.kar_id, w.kar_id::VARCHAR || '/' || w.walk_id AS walk_id, w.circular, w.pos, w.node
  FROM wsteps w JOIN firsts f ON w.kar_id = f.gid * {SAMPLES} + f.sample),
{placed_sql('hv', by='kar_id,').replace('FROM steps', 'FROM psteps')},
grid AS (SELECT x.tile_id AS i, y.tile_id AS j, {_base('hv')} FROM hv x JOIN hv y ON x.tile_id <= y.tile_id),
g2 AS (SELECT grid.*, coalesce(o.value, 0) AS x FROM grid LEFT JOIN obs o ON o.i = grid.i AND o.j = grid.j),
tot AS (SELECT sum({_nll('x', 'base', False)}) AS t FROM g2),
own AS (SELECT kar_id, area, base, x, base + v * {DEPTH / 2!r}::DOUBLE AS mu FROM intra JOIN g2 ON g2.i = intra.i AND g2.j = intra.j),
gains AS (SELECT kar_id, sum({_nll('x', 'mu', False)} - {_nll('x', 'base', False)}) AS g FROM own GROUP BY kar_id),
fits AS (
  SELECT f.gid, f.sample, round((SELECT t FROM tot) + coalesce(g, 0), 1) AS nll
  FROM firsts f LEFT JOIN gains ON gains.kar_id = f.gid * {SAMPLES} + f.sample)"""

CANONICAL = CANON[CANON.index("canon AS"):]

COLLAPSING = f"""WITH RECURSIVE {GENOME}, {CUSTOMER_STEPS}, {NXT}, {WIRING}, {SAMPLED_KARS},
firsts AS (SELECT gid, CAST(min(sample) AS INTEGER) AS sample FROM kars GROUP BY gid, walks, circ, k),
psteps AS (
  SELECT w.kar_id, w.kar_id::VARCHAR || '/' || w.walk_id AS walk_id, w.circular, w.pos, w.node
  FROM wsteps w JOIN firsts f ON w.kar_id = f.gid * {SAMPLES} + f.sample),
{COLLAPSED.replace('FROM steps', 'FROM psteps')},
lists AS (
  SELECT s.kar_id, s.walk_id, s.circular, coalesce(l.a, [{EMPTY}]) AS a FROM (SELECT DISTINCT kar_id, walk_id, circular FROM psteps) s LEFT JOIN (
    SELECT walk_id, list(CASE o WHEN 'NA' THEN 0 ELSE o::INTEGER END ORDER BY k) AS a FROM outp WHERE NOT coalesce(dup, false) GROUP BY walk_id) l USING (walk_id)),
carr AS (SELECT *, list_reverse(list_transform(a, lambda v: -v)) AS b FROM lists),
{CANONICAL.replace('canon AS', 'ccanon AS').replace('FROM arr', 'FROM carr')},
ckars AS (
  SELECT kar_id // {SAMPLES} AS gid, CAST(kar_id % {SAMPLES} AS INTEGER) AS sample,
         list(c::VARCHAR || circular::VARCHAR ORDER BY c::VARCHAR || circular::VARCHAR)::VARCHAR AS k FROM ccanon GROUP BY kar_id)"""

#: Samples that leave the nodes more than 1000 bases away from the amplicon as they are.
FREEZING = SAMPLED.replace(
    sql_draw(7, "s", "gid", "n", "copy") + " AS o",
    f"CASE WHEN n IN (SELECT node_id FROM genome WHERE seqnames IN ('chr1', 'chr2') AND s <= {LAST + 1000} AND e >= {FIRST - 1000}) "
    f"THEN {sql_draw(7, 'r.s', 'gid', 'n', 'copy')} ELSE copy END AS o")
FROZEN_KARS = SAMPLED_KARS.replace(SAMPLED, FREEZING)

BOILING = f"""WITH RECURSIVE {GENOME}, {CUSTOMER_STEPS}, {NXT}, {WIRING}, {FROZEN_KARS},
amp AS (SELECT node_id FROM genome WHERE seqnames IN ('chr1', 'chr2') AND s <= {LAST} AND e >= {FIRST}),
rk AS (
  SELECT gid, walk_id, c, row_number() OVER (PARTITION BY gid, c ORDER BY walk_id) AS first
  FROM (SELECT kar_id // {SAMPLES} AS gid, kar_id::VARCHAR || '/' || walk_id AS walk_id, c FROM canon WHERE circular)),
ring AS (SELECT gid, walk_id, c[i] AS node, c[i % len(c) + 1] AS nx FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM rk WHERE first = 1)),
vis AS (SELECT gid, walk_id, abs(node) AS node_id, count(*) AS m FROM ring GROUP BY ALL),
nfit AS (
  SELECT v.gid, v.walk_id, min(n.cn // m) AS c, sum(g.width * m) FILTER (v.node_id IN (FROM amp)) AS mass
  FROM vis v JOIN nodes n ON n.kar_id = v.gid AND n.node_id = v.node_id JOIN genome g ON g.node_id = v.node_id GROUP BY ALL),
he AS (
  SELECT gid, walk_id, abs(node) AS an, CASE WHEN node > 0 THEN 'right' ELSE 'left' END AS aside,
         abs(nx) AS bn, CASE WHEN nx > 0 THEN 'left' ELSE 'right' END AS bside FROM ring),
je AS (SELECT gid, walk_id, least((an, aside), (bn, bside)) AS lo, greatest((an, aside), (bn, bside)) AS hi, count(*) AS m FROM he GROUP BY ALL),
efit AS (
  SELECT j.gid, j.walk_id, min(e.cn // m) AS c FROM je j
  JOIN edges e ON e.kar_id = j.gid AND (e.n1, e.n1_side) = j.lo AND (e.n2, e.n2_side) = j.hi GROUP BY ALL),
wt AS (SELECT kar_id AS gid, sum(nodes.cn * g.width) AS w FROM nodes JOIN genome g USING (node_id) WHERE node_id IN (FROM amp) GROUP BY kar_id),
rs AS (
  SELECT n.gid, round(least(n.c, e.c) * (least(n.c, e.c) * mass / w), 9) AS score
  FROM nfit n JOIN efit e USING (gid, walk_id) JOIN wt USING (gid) WHERE mass IS NOT NULL AND least(n.c, e.c) > 0)"""

QUERIES = {
    "graph_subset": (graph_subset, f"""WITH {GENOME}, {CUSTOMER_STEPS}, {NXT}, {SUBSET}
        SELECT * FROM inside
        UNION ALL SELECT kar_id, 0, 'right', node_id, 'left', cn, 'LOO' FROM left_over WHERE side = 'left' AND cn > 0
        UNION ALL SELECT kar_id, node_id, 'right', 0, 'left', cn, 'LOO' FROM left_over WHERE side = 'right' AND cn > 0"""),
    "graph_subset_nodes": (graph_subset_nodes, f"WITH {GENOME}, {CUSTOMER_STEPS}, {NXT}, {SUBSET} SELECT kar_id, node_id, source_id, cn FROM kept"),
    "region_group_kl": (region_group_kl, f"""WITH {GENOME}, {REGION_TILES.replace(str(PIX - 1), str(RESOLUTION - 1)).replace(str(PIX), str(RESOLUTION))}, {ORDER_STEPS}, {PAIRS},
        {placed_sql(by='kar_id,')}, {_region_kl('tiles', float(RESOLUTION) ** 2)} SELECT pair_id, round(hic, 5) AS hic FROM hic"""),
    "region_pair_distances": (region_pair_distances, f"""WITH {GENOME}, {CLIPPED.format(src='genome')}, {ORDER_STEPS}, {PAIRS},
        {placed_sql('hv', by='kar_id,')}, {_region_kl('hv', AREA0)} SELECT pair_id, round(hic, 5) AS hic FROM hic"""),
    "export_region_tile_copies": (export_region_tile_copies, f"""WITH {GENOME}, {CUSTOMER_STEPS}, {REGION_COPIES},
        wn AS (SELECT s.column0 AS seqnames, {FIRST} + k * {PIX} AS s, least({FIRST} + k * {PIX} + {PIX - 1}, {LAST}) AS e
               FROM (VALUES ('chr1'), ('chr2'), ('chr5')) s(column0), (SELECT unnest(range(({LAST} - {FIRST}) // {PIX} + 1)) AS k)),
        tl AS (
          SELECT CAST(row_number() OVER (ORDER BY h.seqnames, greatest(h.s, w.s)) AS INTEGER) AS tile_id, h.tile_id AS half,
                 greatest(h.s, w.s) AS s, least(h.e, w.e) AS e, h.s AS hs, h.e AS he
          FROM hv h JOIN wn w ON h.seqnames = w.seqnames AND h.s <= w.e AND w.s <= h.e)
        SELECT t.e - t.s + 1 AS width, unique_id, t.tile_id, t.s - hs + (t.e - t.s + 1)::DOUBLE / 2 AS leftdist,
               he - t.e + (t.e - t.s + 1)::DOUBLE / 2 AS rightdist
        FROM tl t JOIN hc ON hc.tile_id = t.half"""),
    "export_region_external_edges": (export_region_external_edges, f"""WITH {GENOME}, {CUSTOMER_STEPS}, {NXT}, {_edges('')}, {REGION_COPIES},
        ec AS (SELECT *, row_number() OVER (ORDER BY n1, n1_side, n2, n2_side) AS edge_id FROM (SELECT edges.*, unnest(range(cn)) AS k FROM edges)),
        en AS (SELECT edge_id, 1 AS role, n1 AS node_id, n1_side AS side FROM ec UNION ALL SELECT edge_id, 2, n2, n2_side FROM ec),
        eo AS (SELECT *, row_number() OVER (PARTITION BY node_id, side ORDER BY role, edge_id) AS occ FROM en),
        ep AS (SELECT edge_id, role, unique_id FROM eo LEFT JOIN hc USING (node_id, side, occ))
        SELECT edge_id, max(unique_id) FILTER (role = 1) AS n1, max(unique_id) FILTER (role = 2) AS n2 FROM ep GROUP BY edge_id"""),
    "bestfit_search": (bestfit_search, f"""{FITS}
        SELECT gid, sample, nll, CAST(rank AS INTEGER) AS rank FROM (SELECT *, rank() OVER (PARTITION BY gid ORDER BY nll) AS rank FROM fits) WHERE rank = 1"""),
    "sampled_collapsed": (sampled_collapsed, f"{COLLAPSING} SELECT gid, min(sample) AS sample, count(*) AS karyotypes FROM ckars GROUP BY gid, k"),
    "boiled": (boiled, f"""{BOILING}
        SELECT gid, CAST(r AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY score DESC) AS r FROM rs) WHERE r <= {TOP}"""),
    "squeezed_region": (squeezed_region, f"""WITH RECURSIVE {GENOME}, {CUSTOMER_STEPS}, {NXT}, {WIRING}, {FROZEN_KARS},
        amp AS (SELECT node_id FROM genome WHERE seqnames IN ('chr1', 'chr2') AND s <= {LAST} AND e >= {FIRST}),
        c AS (SELECT kar_id, walk_id, count(*)::DOUBLE AS c FROM wsteps WHERE abs(node) IN (FROM amp) GROUP BY ALL),
        f AS (SELECT kar_id, c / sum(c) OVER (PARTITION BY kar_id) AS f FROM c),
        en AS (SELECT kar_id // {SAMPLES} AS gid, kar_id % {SAMPLES} AS sample, abs(round(-sum(f * ln(f)), 9)) AS entropy FROM f GROUP BY kar_id),
        rn AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY entropy, sample) AS r FROM en)
        SELECT gid, CAST(sample AS INTEGER) AS sample, entropy FROM rn WHERE r = 1"""),
}

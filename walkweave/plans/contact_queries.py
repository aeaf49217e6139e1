"""Registered queries over tiles, intervals and simulated contact maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from walkweave.operators import contact as K
from walkweave.operators import intervals as I
from walkweave.plans import tables as T
from walkweave.plans.oracle import CONTACTS, CUSTOMER_STEPS, GENOME
from walkweave.sources.calibration import INTERCHROM_DENSITY, MIN_RESOLUTION, SYNTHETIC

PIX = 10_000
WINDOW = 45_000
BIN = 1 << 16
DEPTH = 20
READ_LENGTH = 5000


def chromosomes(nodes):
    return nodes.groupBy("seqnames").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def tiles(spark, sf):
    return I.tile_nodes(T.genome(spark, sf), PIX)


def half_nodes(spark, sf):
    return I.half_nodes(T.genome(spark, sf))


def genome_windows(spark, sf):
    return I.windows(chromosomes(T.genome(spark, sf)), WINDOW)


def tile_template(spark, sf):
    return K.template(tiles(spark, sf))


def compartment_ranges(spark, sf):
    """First 60 % of two nodes in three are A or B."""
    kind = F.when(F.col("node_id") % 3 == 0, "A").when(F.col("node_id") % 3 == 1, "B")
    return T.genome(spark, sf).withColumn("compartment", kind).filter("compartment IS NOT NULL").select(
        "seqnames", "start", (F.col("start") + F.floor(F.col("width") * 6 / 10)).alias("end"), "compartment")


def template_compartments(spark, sf):
    labelled = K.compartments(half_nodes(spark, sf), compartment_ranges(spark, sf), BIN)
    return K.template(labelled, interactions=True)


def line_ranges(spark, sf):
    """One range per line: a placement on the genome taken from its keys."""
    li = T.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    start = (F.col("l_partkey") * 131 + F.col("l_suppkey") * 17 + F.col("l_linenumber")) % 300000 + 1
    return li.select(
        "l_orderkey", F.concat(F.lit("chr"), (F.col("l_suppkey") % 12 + 1).cast("string")).alias("seqnames"),
        start.alias("start"), (start + (F.col("l_quantity") * 100).cast("long")).alias("end"))


def range_overlaps(spark, sf):
    """Lines and covered bases per tile (binned overlap join)."""
    hits = I.overlap_join(line_ranges(spark, sf), tiles(spark, sf).select("tile_id", "seqnames", "start", "end"), BIN)
    return hits.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("hits"), F.sum(F.col("end") - F.col("start") + 1).alias("bases"))


def sparse_ranges(spark, sf):
    li = T.read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    start = (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 50000000 + 1
    return li.select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 12 + 1).cast("string")).alias("seqnames"),
        start.alias("start"), (start + (F.col("l_quantity") * 20).cast("long")).alias("end"))


def range_footprint(spark, sf):
    return I.footprint(sparse_ranges(spark, sf))


def range_semi(spark, sf):
    """Tiles touched by any A compartment."""
    a = compartment_ranges(spark, sf).filter("compartment = 'A'").select("seqnames", "start", "end")
    return I.overlap_semi(tiles(spark, sf), a, BIN, "tile_id").select("tile_id", "node_id")


def _node_tiles(spark, sf):
    return T.genome(spark, sf).select(F.col("node_id").alias("tile_id"), "node_id", "seqnames", "start", "end", "width", "cn")


def rebin_contacts(spark, sf):
    """Observed contacts between segments moved to fixed windows."""
    moved = I.rebin(T.contacts(spark, sf), _node_tiles(spark, sf), genome_windows(spark, sf), BIN)
    return moved.withColumn("value", F.round("value", 4))


def coarse_grain(spark, sf):
    return I.coarse_grain(T.contacts(spark, sf), (1, 2, 5, 10, 20), 1)


def simulated(spark, sf, pix=PIX, model=0, interchrom=True, regions=None, depth=DEPTH):
    walks, nodes = T.customer_walks(spark, sf), T.genome(spark, sf)
    grid = I.tile_nodes(nodes, pix, regions)
    return K.simulate(walks.df, nodes, grid, depth, model, interchrom, split=walks.split, longest=walks.longest)


def contact_map(spark, sf):
    return simulated(spark, sf).withColumn("value", F.round("value", 4))


def contact_longread(spark, sf):
    return simulated(spark, sf, model=READ_LENGTH).withColumn("value", F.round("value", 4)).drop("widthprod")


def contact_region(spark, sf):
    """A target region that cuts nodes: walks shrink to the tiled part of a node."""
    regions = chromosomes(T.genome(spark, sf)).filter("seqnames IN ('chr1', 'chr2', 'chr5')").select(
        "seqnames", F.lit(30001).cast("long").alias("start"), F.lit(170000).cast("long").alias("end"))
    return simulated(spark, sf, regions=regions).withColumn("value", F.round("value", 4)).drop("widthprod")


def walk_mass(spark, sf):
    """One map per walk on half nodes, summed up per walk."""
    walks, nodes = T.customer_walks(spark, sf), T.genome(spark, sf)
    pix = K.small_pixels(walks.df, nodes, I.half_nodes(nodes), "walk_id", split=walks.split, longest=walks.longest)
    return pix.groupBy("walk_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.round(F.sum("value"), 6).alias("mass"), F.round(F.max("value"), 6).alias("peak"))


def contact_coverage(spark, sf):
    return K.coverage(simulated(spark, sf)).withColumn("cov", F.round("cov", 3))


def symmetric_contacts(spark, sf):
    return K.symmetrize(T.contacts(spark, sf))


def map_difference(spark, sf):
    """Contacts of returned minus other lines, on the full symmetric matrix."""
    li = T.read(spark, sf, "lineitem")
    a, b = ((F.col(c) % T.SEGMENTS + 1).cast("int") for c in ("l_partkey", "l_suppkey"))
    maps = li.groupBy(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(-F.col("l_quantity"))).alias("value"))
    return K.symmetrize(maps)


def offset_means(spark, sf):
    """Mean simulated and observed contacts per pixel offset."""
    sim = I.rebin(simulated(spark, sf, pix=50_000), I.tile_nodes(T.genome(spark, sf), 50_000), _node_tiles(spark, sf), BIN)
    both = sim.join(T.contacts(spark, sf).withColumnRenamed("value", "obs"), ["i", "j"], "left")
    return both.groupBy(F.abs(F.col("j") - F.col("i")).alias("offset")).agg(
        F.round(F.avg("value"), 5).alias("simulated"), F.round(F.avg(F.coalesce("obs", F.lit(0.0))), 5).alias("observed"))


def abc_scores(spark, sf):
    """Suppliers as enhancers, nations as promoters, observed segment contacts between them."""
    place = lambda key, c: F.concat(F.lit("chr"), (F.col(key) % 12 + 1).cast("string"))
    start = (F.col("s_suppkey") * 4099) % 250000 + 1
    enhancers = T.read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("enhancer_id"), place("s_suppkey", 0).alias("seqnames"), start.alias("start"),
        (start + 1500).alias("end"), (F.abs("s_acctbal") + 1).alias("score"))
    at = (F.col("n_nationkey").cast("long") * 9973) % 250000 + 1
    promoters = T.read(spark, sf, "nation").select(
        F.col("n_name").alias("gene"), place("n_nationkey", 0).alias("seqnames"), at.alias("start"), (at + 800).alias("end"))
    scores = K.abc_scores(enhancers, promoters, T.contacts(spark, sf), _node_tiles(spark, sf), BIN)
    return scores.withColumn("score", F.round("score", 9))


# ---- oracle text -------------------------------------------------------------------------------

TILES = f"""
regions AS (SELECT seqnames, min(s) AS rs, max(e) AS re FROM genome GROUP BY seqnames),
tiles AS (
  SELECT CAST(row_number() OVER (ORDER BY seqnames, node_id, k) AS INTEGER) AS tile_id, node_id, seqnames,
         greatest(s, rs, rs + k * {PIX}) AS s, least(e, re, rs + k * {PIX} + {PIX - 1}) AS e, cn
  FROM (SELECT g.*, rs, re, unnest(range((greatest(s, rs) - rs) // {PIX}, (least(e, re) - rs) // {PIX} + 1)) AS k
        FROM genome g JOIN regions USING (seqnames) WHERE s <= re AND rs <= e))"""

HALVES = """
halves AS (
  SELECT CAST(node_id * 2 - 1 AS INTEGER) AS tile_id, node_id, seqnames, 'left' AS side, s, s + width // 2 - 1 AS e, cn FROM genome
  UNION ALL SELECT CAST(node_id * 2 AS INTEGER), node_id, seqnames, 'right', s + width // 2, e, cn FROM genome)"""

COMPARTMENTS = """
comps AS (
  SELECT seqnames, s, s + width * 6 // 10 AS e, CASE node_id % 3 WHEN 0 THEN 'A' ELSE 'B' END AS compartment
  FROM genome WHERE node_id % 3 <> 2)"""

WINDOWS = f"""
wins AS (
  SELECT CAST(row_number() OVER (ORDER BY seqnames, k) AS INTEGER) AS tile_id, seqnames,
         rs + k * {WINDOW} AS s, least(rs + k * {WINDOW} + {WINDOW - 1}, re) AS e
  FROM (SELECT seqnames, rs, re, unnest(range((re - rs) // {WINDOW} + 1)) AS k
        FROM (SELECT seqnames, min(s) AS rs, max(e) AS re FROM genome GROUP BY seqnames)))"""

LINES = """
lines AS (
  SELECT seqnames, s, s + CAST(q * 100 AS BIGINT) AS e FROM (
    SELECT 'chr' || CAST(l_suppkey % 12 + 1 AS VARCHAR) AS seqnames,
           (l_partkey * 131 + l_suppkey * 17 + l_linenumber) % 300000 + 1 AS s, l_quantity AS q FROM lineitem))"""

SPARSE = """
lines AS (
  SELECT seqnames, s, s + CAST(q * 20 AS BIGINT) AS e FROM (
    SELECT 'chr' || CAST(l_suppkey % 12 + 1 AS VARCHAR) AS seqnames,
           (l_partkey * 7919 + l_suppkey * 104729) % 50000000 + 1 AS s, l_quantity AS q FROM lineitem))"""


def placed_sql(tiles: str = "tiles", model: str = "decay", by: str = "") -> str:
    """CTEs ``placed`` and ``intra(by, i, j, v)`` over ``steps``, ``genome`` and a tile table."""
    area, d = "area", "d"
    value = SYNTHETIC.sql_contact(area, d) if model == "decay" else (
        f"area / {10.0 * MIN_RESOLUTION**2!r}::DOUBLE * exp(-d / {float(READ_LENGTH)!r}::DOUBLE)")
    return f"""
tw AS (SELECT node_id, tile_id, e - s + 1 AS tw, sum(e - s + 1) OVER (PARTITION BY node_id ORDER BY tile_id) - (e - s + 1) AS off,
              sum(e - s + 1) OVER (PARTITION BY node_id) AS nw FROM {tiles}),
nws AS (SELECT g.node_id, coalesce(max(tw.nw), g.width) AS nw FROM genome g LEFT JOIN tw USING (node_id) GROUP BY g.node_id, g.width),
crd AS (
  SELECT st.*, nw, sum(nw) OVER (PARTITION BY walk_id ORDER BY pos) AS endp, sum(nw) OVER (PARTITION BY walk_id) AS len
  FROM steps st JOIN nws ON nws.node_id = abs(st.node)),
placed AS (
  SELECT c.kar_id, c.walk_id, c.circular, c.len::DOUBLE AS len, tw.tile_id, tw.tw::DOUBLE AS tw,
         (c.endp - c.nw + CASE WHEN c.node > 0 THEN tw.off ELSE c.nw - tw.off - tw.tw END)::DOUBLE + (tw.tw + 1)::DOUBLE / 2 AS mid
  FROM crd c JOIN tw ON tw.node_id = abs(c.node)),
tpairs AS (
  SELECT a.kar_id, a.walk_id, a.tile_id AS p, b.tile_id AS q, a.tw * b.tw AS area, a.mid < b.mid AS apart,
         CASE WHEN a.circular THEN least(b.mid - a.mid, a.len - (b.mid - a.mid)) ELSE b.mid - a.mid END AS d
  FROM placed a JOIN placed b ON a.walk_id = b.walk_id AND a.mid <= b.mid),
intra AS (
  SELECT {by} least(p, q) AS i, greatest(p, q) AS j,
         sum(({value}) * CASE WHEN p = q AND apart THEN 2 ELSE 1 END) AS v
  FROM tpairs GROUP BY ALL)"""


def map_sql(tiles: str = "tiles", density: float = INTERCHROM_DENSITY, depth: float = DEPTH) -> str:
    """CTE ``map(i, j, id, widthprod, value)``: template, background and ``intra``."""
    return f"""
cnt AS (SELECT max(tile_id) AS m FROM {tiles}),
grid AS (
  SELECT a.tile_id AS i, b.tile_id AS j, (a.e - a.s + 1)::DOUBLE * (b.e - b.s + 1) AS widthprod, a.cn * b.cn AS cc,
         (a.tile_id - 1)::BIGINT * m - (a.tile_id - 1)::BIGINT * (a.tile_id - 2) // 2 + b.tile_id - a.tile_id + 1 AS id
  FROM {tiles} a JOIN {tiles} b ON a.tile_id <= b.tile_id CROSS JOIN cnt),
map AS (
  SELECT g.i, g.j, g.id, g.widthprod,
         (g.widthprod * {density!r}::DOUBLE * g.cc + coalesce(x.v, 0)) * {depth / 2!r}::DOUBLE AS value
  FROM grid g LEFT JOIN intra x ON x.i = g.i AND x.j = g.j)"""


def rebin_sql(source: str, target: str, pixels: str, out: str) -> str:
    return f"""
frac AS (
  SELECT a.tile_id AS src, b.tile_id AS dst, (least(a.e, b.e) - greatest(a.s, b.s) + 1)::DOUBLE / (a.e - a.s + 1) AS f
  FROM {source} a JOIN {target} b ON a.seqnames = b.seqnames AND a.s <= b.e AND b.s <= a.e),
{out} AS (
  SELECT least(x.dst, y.dst) AS i, greatest(x.dst, y.dst) AS j, sum(value * x.f * y.f) AS value
  FROM {pixels} p JOIN frac x ON x.src = p.i JOIN frac y ON y.src = p.j GROUP BY ALL)"""


NODE_TILES = "ntiles AS (SELECT node_id AS tile_id, node_id, seqnames, s, e, width, cn FROM genome)"
BASE = f"WITH {GENOME}, {TILES}"
SIM = f"{BASE}, {CUSTOMER_STEPS}, {placed_sql()}, {map_sql()}"
REGION_TILES = TILES.replace(
    "SELECT seqnames, min(s) AS rs, max(e) AS re FROM genome GROUP BY seqnames",
    "SELECT s.column0 AS seqnames, 30001::BIGINT AS rs, 170000::BIGINT AS re FROM (VALUES ('chr1'), ('chr2'), ('chr5')) s(column0)")
COARSE_TILES = TILES.replace(str(PIX - 1), "49999").replace(str(PIX), "50000")

QUERIES = {
    "tiles": (tiles, f'{BASE} SELECT tile_id, node_id, seqnames, s AS "start", e AS "end", e - s + 1 AS width, cn FROM tiles'),
    "half_nodes": (half_nodes, f"""WITH {GENOME}, {HALVES}
        SELECT tile_id, node_id, seqnames, side, s AS "start", e AS "end", e - s + 1 AS width, cn FROM halves"""),
    "genome_windows": (genome_windows, f'WITH {GENOME}, {WINDOWS} SELECT tile_id, seqnames, s AS "start", e AS "end" FROM wins'),
    "tile_template": (tile_template, f"""{BASE}
        SELECT a.tile_id AS i, b.tile_id AS j, row_number() OVER (ORDER BY a.tile_id, b.tile_id) AS id,
               (a.e - a.s + 1)::DOUBLE * (b.e - b.s + 1) AS widthprod
        FROM tiles a JOIN tiles b ON a.tile_id <= b.tile_id"""),
    "template_compartments": (template_compartments, f"""WITH {GENOME}, {HALVES}, {COMPARTMENTS},
        lab AS (
          SELECT h.tile_id, h.s, h.e,
                 coalesce(sum(least(h.e, c.e) - greatest(h.s, c.s) + 1) FILTER (c.compartment = 'A'), 0) / (h.e - h.s + 1) AS a,
                 coalesce(sum(least(h.e, c.e) - greatest(h.s, c.s) + 1) FILTER (c.compartment = 'B'), 0) / (h.e - h.s + 1) AS b
          FROM halves h LEFT JOIN comps c ON h.seqnames = c.seqnames AND h.s <= c.e AND c.s <= h.e GROUP BY h.tile_id, h.s, h.e),
        k AS (SELECT tile_id, s, e, CASE WHEN a > 0.5 AND b < 0.5 THEN 'A' WHEN a < 0.5 AND b > 0.5 THEN 'B' END AS c FROM lab)
        SELECT x.tile_id AS i, y.tile_id AS j, row_number() OVER (ORDER BY x.tile_id, y.tile_id) AS id,
               (x.e - x.s + 1)::DOUBLE * (y.e - y.s + 1) AS widthprod,
               CASE WHEN x.c = y.c THEN 'same' WHEN x.c <> y.c THEN 'diff' END AS interaction
        FROM k x JOIN k y ON x.tile_id <= y.tile_id"""),
    "range_overlaps": (range_overlaps, f"""{BASE}, {LINES}
        SELECT tile_id, count(*) AS hits, CAST(sum(least(t.e, l.e) - greatest(t.s, l.s) + 1) AS BIGINT) AS bases
        FROM tiles t JOIN lines l ON t.seqnames = l.seqnames AND t.s <= l.e AND l.s <= t.e GROUP BY tile_id"""),
    "range_footprint": (range_footprint, f"""WITH {SPARSE},
        o AS (SELECT *, max(e) OVER (PARTITION BY seqnames ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lines),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seqnames ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM o)
        SELECT seqnames, min(s) AS "start", max(e) AS "end" FROM g GROUP BY seqnames, run"""),
    "range_semi": (range_semi, f"""{BASE}, {COMPARTMENTS}
        SELECT tile_id, node_id FROM tiles t WHERE EXISTS (
          SELECT 1 FROM comps c WHERE c.compartment = 'A' AND c.seqnames = t.seqnames AND t.s <= c.e AND c.s <= t.e)"""),
    "rebin_contacts": (rebin_contacts, f"""WITH {GENOME}, {WINDOWS}, {CONTACTS}, {rebin_sql('genome_t', 'wins', 'contacts', 'moved')}
        SELECT i, j, round(value, 4) AS value FROM moved""".replace(
            "frac AS", "genome_t AS (SELECT node_id AS tile_id, seqnames, s, e FROM genome), frac AS", 1)),
    "coarse_grain": (coarse_grain, f"""WITH {CONTACTS}
        SELECT CAST(r AS INTEGER) AS resolution, CAST((i - 1) // r + 1 AS INTEGER) AS i, CAST((j - 1) // r + 1 AS INTEGER) AS j, sum(value) AS value
        FROM contacts CROSS JOIN (VALUES (1), (2), (5), (10), (20)) v(r) GROUP BY ALL"""),
    "contact_map": (contact_map, f"{SIM} SELECT i, j, id, widthprod, round(value, 4) AS value FROM map"),
    "contact_longread": (contact_longread, f"""{BASE}, {CUSTOMER_STEPS}, {placed_sql(model='read')}, {map_sql(density=0.0)}
        SELECT i, j, id, round(value, 4) AS value FROM map"""),
    "contact_region": (contact_region, f"""WITH {GENOME}, {REGION_TILES}, {CUSTOMER_STEPS}, {placed_sql()}, {map_sql()}
        SELECT i, j, id, round(value, 4) AS value FROM map"""),
    "walk_mass": (walk_mass, f"""WITH {GENOME}, {HALVES}, {CUSTOMER_STEPS}, {placed_sql('halves', by='walk_id,')}
        SELECT walk_id, count(*) AS pixels, round(sum(v), 6) AS mass, round(max(v), 6) AS peak FROM intra GROUP BY walk_id"""),
    "contact_coverage": (contact_coverage, f"""{SIM}
        SELECT tile_id, round(sum(value), 3) AS cov FROM (
          SELECT i AS tile_id, value FROM map UNION ALL SELECT j, value FROM map WHERE i <> j) GROUP BY tile_id"""),
    "symmetric_contacts": (symmetric_contacts, f"""WITH {CONTACTS}
        SELECT i, j, value FROM contacts UNION ALL SELECT j, i, value FROM contacts WHERE i <> j"""),
    "map_difference": (map_difference, f"""WITH {CONTACTS.replace('contacts AS', 'r AS').replace('FROM lineitem', "FROM lineitem WHERE l_returnflag = 'R'")},
        {CONTACTS.replace('contacts AS', 'o AS').replace('FROM lineitem', "FROM lineitem WHERE l_returnflag <> 'R'")},
        d AS (SELECT coalesce(r.i, o.i) AS i, coalesce(r.j, o.j) AS j, coalesce(r.value, 0) - coalesce(o.value, 0) AS value
              FROM r FULL JOIN o ON r.i = o.i AND r.j = o.j)
        SELECT i, j, value FROM d UNION ALL SELECT j, i, value FROM d WHERE i <> j"""),
    "offset_means": (offset_means, f"""WITH {GENOME}, {COARSE_TILES}, {CUSTOMER_STEPS}, {placed_sql()}, {map_sql()}, {CONTACTS}, {NODE_TILES},
        {rebin_sql('tiles', 'ntiles', 'map', 'sim')}
        SELECT abs(s.j - s.i) AS "offset", round(avg(s.value), 5) AS simulated, round(avg(coalesce(c.value, 0)), 5) AS observed
        FROM sim s LEFT JOIN contacts c ON c.i = s.i AND c.j = s.j GROUP BY 1"""),
    "abc_scores": (abc_scores, f"""WITH {GENOME}, {NODE_TILES}, {CONTACTS},
        enh AS (SELECT s_suppkey AS enhancer_id, 'chr' || CAST(s_suppkey % 12 + 1 AS VARCHAR) AS seqnames,
                       s_suppkey * 4099 % 250000 + 1 AS s, s_suppkey * 4099 % 250000 + 1501 AS e, abs(s_acctbal) + 1 AS act FROM supplier),
        prom AS (SELECT n_name AS gene, 'chr' || CAST(n_nationkey % 12 + 1 AS VARCHAR) AS seqnames,
                        n_nationkey::BIGINT * 9973 % 250000 + 1 AS s, n_nationkey::BIGINT * 9973 % 250000 + 801 AS e FROM nation),
        full_c AS (SELECT i, j, value FROM contacts UNION ALL SELECT j, i, value FROM contacts),
        raw AS (
          SELECT enhancer_id, gene, sum(value) * any_value(act) AS raw
          FROM full_c c JOIN ntiles a ON a.tile_id = c.i JOIN enh ON enh.seqnames = a.seqnames AND enh.s <= a.e AND a.s <= enh.e
          JOIN ntiles b ON b.tile_id = c.j JOIN prom ON prom.seqnames = b.seqnames AND prom.s <= b.e AND b.s <= prom.e
          GROUP BY enhancer_id, gene)
        SELECT enhancer_id, gene, round(raw / (sum(raw) OVER (PARTITION BY gene) + 1e-12), 9) AS score FROM raw"""),
}

"""Registered queries over graphs, wirings, walks, canonical forms and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from walkweave.functions.rand import sql_draw
from walkweave.operators import canonical as C
from walkweave.operators import graph as G
from walkweave.operators import sampling as S
from walkweave.operators.canonical import ARRAY_STEPS
from walkweave.operators.traversal import LOCAL_ROWS, traverse
from walkweave.plans import tables as T
from walkweave.plans.oracle import CUSTOMER_STEPS, GENOME, ORDER_STEPS
from walkweave.session import cut

BY = ["kar_id"]
CHR = T.PER_CHROMOSOME


def genome_nodes(spark, sf):
    return T.genome(spark, sf)


def graph_nodes(spark, sf):
    return G.walk_nodes(T.customer_walks(spark, sf).df, BY)


def graph_edges(spark, sf):
    return G.walk_edges(T.customer_walks(spark, sf).df, BY, CHR)


def population_edges(spark, sf):
    return G.walk_edges(T.customer_walks(spark, sf).df, [], CHR)


def loose_ends(spark, sf):
    steps = T.customer_walks(spark, sf).df
    return G.loose_ends(G.walk_nodes(steps), G.walk_edges(steps, [], CHR))


def _external(spark, sf):
    walks = T.customer_walks(spark, sf)
    return cut(G.subids(G.walk_external(walks.df, BY, CHR, deal=not walks.hot_kar), BY, walks.hot_kar)), walks.hot_kar


def external_edges(spark, sf):
    return _external(spark, sf)[0]


def wiring(spark, sf):
    ext, split = _external(spark, sf)
    return G.wiring(ext, BY, split).drop("id")


def _gid_wiring(spark, sf):
    ext, split = _external(spark, sf)
    return G.wiring(ext, BY, split).withColumnRenamed("kar_id", "gid"), split


def _bounded_wiring(spark, sf):
    """The wirings of all graphs (each in one partition unless some is hot), whether some is hot, and the rows of the largest."""
    ext, split = _external(spark, sf)
    return G.wiring(ext, BY, split, deal=True).withColumnRenamed("kar_id", "gid"), split, G.largest_wiring(ext, BY)


def smoothed_cn(spark, sf):
    steps = T.customer_walks(spark, sf).df
    edges = cut(G.walk_edges(steps, [], CHR))
    return G.smoothed_cn(G.walk_nodes(steps), edges)


def walks_from_wiring(spark, sf):
    w, _ = _gid_wiring(spark, sf)
    return traverse(w).drop("row_id")


def canonical_steps(spark, sf):
    walks = T.order_walks(spark, sf)
    return C.canonical_steps(walks.df, bound=walks.longest).select("walk_id", "pos", "node")


def walk_classes(spark, sf):
    walks = T.customer_walks(spark, sf)
    keys = cut(C.walk_keys(walks.df, bound=walks.longest))
    return C.representatives(keys, "walk_id").select("walk_id", "rep_id", "members")


def karyotype_classes(spark, sf):
    walks = T.order_walks(spark, sf)
    keys = cut(C.karyotype_keys(C.walk_keys(walks.df, bound=walks.longest)))
    return C.representatives(keys, "kar_id").select("kar_id", "rep_id", "members")


def unique_circular_walks(spark, sf):
    walks = T.customer_walks(spark, sf)
    keys = C.walk_keys(walks.df, bound=walks.longest)
    return C.unique_walks(keys, "walk_id", "circular").select("walk_id", F.col("len").alias("n"), "members")


def linear_karyotypes(spark, sf):
    kept = C.drop_circular(T.order_walks(spark, sf).df)
    return kept.groupBy("kar_id").agg(F.countDistinct("walk_id").alias("walks"), F.count(F.lit(1)).alias("steps"))


SAMPLES = 4


def _sampled_kars(spark, sf):
    w, split, largest = _bounded_wiring(spark, sf)
    walks = S.sample_walks(w, SAMPLES, seed=7, unique=False, split=split, largest=largest, lists=True, dealt=not split)
    return S.unique_karyotypes(walks if largest <= ARRAY_STEPS else cut(walks), largest)


def sampled_karyotypes(spark, sf):
    kars = _sampled_kars(spark, sf)
    return kars.select("gid", (F.col("kar_id") % SAMPLES).cast("int").alias("sample"), F.col("len").alias("walks"), "circ")


def sampled_wirings(spark, sf):
    w, split, largest = _bounded_wiring(spark, sf)
    return S.sample_wirings(w, SAMPLES, seed=7, split=split, largest=largest, dealt=not split).select("gid", "sample", "n", "copy", "left", "right")


#: Samples of a graph after which its distinct karyotypes are counted.
SATURATING = (100, 500, 2000, 10_000)


def saturation(spark, sf):
    """Distinct karyotypes of every graph among its first samples: whether their number levels off."""
    w, split, largest = _bounded_wiring(spark, sf)
    kars = S.sampled_karyotypes(w, SATURATING[-1], seed=7, split=split, largest=largest)
    return S.saturation(kars, SATURATING, SATURATING[-1])


def markov_moves(spark, sf):
    w, _ = _gid_wiring(spark, sf)
    return S.transpositions(w, chains=2, steps=3, seed=11)


def markov_chains(spark, sf):
    w, split, largest = _bounded_wiring(spark, sf)
    return _state_sizes(S.markov_walks(w, chains=2, steps=3, seed=11, split=split, largest=largest, dealt=not split, lists=True))


def _state_sizes(walks):
    """Walks, rings and rows of every state of a chain, from walks as steps or lists."""
    heads = walks.withColumn("n", F.size("nodes").cast("long")) if "nodes" in walks.columns else walks.filter("pos = 1")
    return heads.groupBy("gid", "chain", "step").agg(
        F.count(F.lit(1)).alias("walks"), F.sum(F.col("circular").cast("int")).alias("rings"), F.sum("n").alias("rows"))


AVOID_CHAINS, AVOID_ATTEMPTS, AVOID_STEPS, AVOID_SEED = 2, 2, 2, 31


def self_avoiding_chains(spark, sf):
    """Chains from starts of their own that show no karyotype twice; the walks of every state they reach."""
    w, split, largest = _bounded_wiring(spark, sf)
    w = w if largest <= LOCAL_ROWS else cut(w)
    return _state_sizes(S.self_avoiding_chains(w, AVOID_CHAINS, AVOID_STEPS, AVOID_ATTEMPTS, AVOID_SEED, split, largest, dealt=not split, lists=True))


# ---- oracle text -------------------------------------------------------------------------------

NXT = """
hops AS (
  SELECT kar_id, walk_id, node AS a,
         CASE WHEN pos < n THEN lead(node) OVER w WHEN circular THEN first_value(node) OVER w END AS b
  FROM steps WINDOW w AS (PARTITION BY walk_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ends AS (
  SELECT kar_id, abs(a) AS an, CASE WHEN a > 0 THEN 'right' ELSE 'left' END AS aside,
         abs(b) AS bn, CASE WHEN b > 0 THEN 'left' ELSE 'right' END AS bside
  FROM hops WHERE b IS NOT NULL),
flat AS (
  SELECT kar_id,
         CASE WHEN (an, aside) <= (bn, bside) THEN an ELSE bn END AS n1,
         CASE WHEN (an, aside) <= (bn, bside) THEN aside ELSE bside END AS n1_side,
         CASE WHEN (an, aside) <= (bn, bside) THEN bn ELSE an END AS n2,
         CASE WHEN (an, aside) <= (bn, bside) THEN bside ELSE aside END AS n2_side
  FROM ends)"""

REF = ("CASE WHEN n2 = n1 + 1 AND n1_side = 'right' AND n2_side = 'left' AND n1 % 10 <> 0 "
       "THEN 'REF' ELSE 'ALT' END AS type")


def _edges(by: str) -> str:
    return f"edges AS (SELECT {by} n1, n1_side, n2, n2_side, count(*) AS cn, {REF} FROM flat GROUP BY ALL)"


LOOSE = """
nodes AS (SELECT kar_id, abs(node) AS node_id, count(*) AS cn FROM steps GROUP BY ALL),
used AS (
  SELECT kar_id, node_id, side, sum(cn) AS used FROM (
    SELECT kar_id, n1 AS node_id, n1_side AS side, cn FROM edges
    UNION ALL SELECT kar_id, n2, n2_side, cn FROM edges) GROUP BY ALL),
loose AS (
  SELECT n.kar_id, n.node_id, s.side, n.cn AS node_cn, CAST(n.cn - coalesce(u.used, 0) AS BIGINT) AS cn
  FROM nodes n CROSS JOIN (VALUES ('left'), ('right')) s(side)
  LEFT JOIN used u ON u.kar_id = n.kar_id AND u.node_id = n.node_id AND u.side = s.side)"""

EXTERNAL = f"""
{_edges('kar_id,')},
{LOOSE},
ext0 AS (
  SELECT kar_id, n1, n1_side, n2, n2_side, cn, type, 0 AS cls FROM edges
  UNION ALL SELECT kar_id, 0, 'right', node_id, 'left', cn, 'LOO', 1 FROM loose WHERE side = 'left' AND cn > 0
  UNION ALL SELECT kar_id, node_id, 'right', 0, 'left', cn, 'LOO', 2 FROM loose WHERE side = 'right' AND cn > 0),
ext AS MATERIALIZED (
  SELECT kar_id, n1, n1_side, n2, n2_side, cn, type,
         CAST(coalesce(sum(cn) OVER (PARTITION BY kar_id ORDER BY cls, n1, n1_side, n2, n2_side
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_subid
  FROM ext0)"""

WIRING = f"""
{EXTERNAL},
halves AS (
  SELECT kar_id, n1 AS n, n1_side AS side, 1 AS role, first_subid + unnest(range(cn)) + 1 AS subid FROM ext WHERE n1 > 0
  UNION ALL
  SELECT kar_id, n2, n2_side, 2, first_subid + unnest(range(cn)) + 1 FROM ext WHERE n2 > 0),
slots AS MATERIALIZED (
  SELECT kar_id, n, side, subid,
         row_number() OVER (PARTITION BY kar_id, n, side ORDER BY role, subid) AS copy FROM halves),
wiring AS MATERIALIZED (
  SELECT kar_id AS gid, n, copy, max(subid) FILTER (side = 'left') AS "left", max(subid) FILTER (side = 'right') AS "right"
  FROM slots GROUP BY kar_id, n, copy)"""


def walked(src: str) -> str:
    """Recursive traversal of ``src(gid, n, copy, left, right)`` into ``walked(gid, circular, head, pos, node)``."""
    return f"""
w AS (SELECT gid, n, n * 1000000 + copy AS id, "left" AS l, "right" AS r FROM {src}),
st AS (SELECT gid, id, n, 1 AS d, l AS e, r AS x FROM w UNION ALL SELECT gid, id, -n, -1, r, l FROM w),
nx AS (
  SELECT a.gid, a.id, a.d, b.id AS id2, b.d AS d2 FROM st a JOIN st b
  ON a.gid = b.gid AND a.x = b.e AND NOT (b.id = a.id AND b.d = -a.d)),
heads AS (
  SELECT s.gid, s.id, s.d, s.e FROM st s
  WHERE NOT EXISTS (SELECT 1 FROM st t WHERE t.gid = s.gid AND t.e = s.e AND NOT (t.id = s.id AND t.d = s.d))),
lin AS (
  SELECT gid, e AS head, id, d, 1 AS pos FROM heads
  UNION ALL
  SELECT l.gid, l.head, nx.id2, nx.d2, l.pos + 1 FROM lin l JOIN nx ON nx.gid = l.gid AND nx.id = l.id AND nx.d = l.d),
lin_ok AS (
  SELECT l.gid, l.head FROM lin l JOIN st ON st.gid = l.gid AND st.id = l.id AND st.d = l.d
  GROUP BY l.gid, l.head HAVING l.head < arg_max(st.x, l.pos)),
rest AS (SELECT w.gid, w.id FROM w ANTI JOIN lin ON w.gid = lin.gid AND w.id = lin.id),
cyc AS (
  SELECT gid, id AS head, id, 1 AS d, 1 AS pos FROM rest
  UNION ALL
  SELECT c.gid, c.head, nx.id2, nx.d2, c.pos + 1 FROM cyc c JOIN nx ON nx.gid = c.gid AND nx.id = c.id AND nx.d = c.d
  WHERE nx.id2 > c.head),
cyc_ok AS (
  SELECT c.gid, c.head FROM cyc c JOIN nx ON nx.gid = c.gid AND nx.id = c.id AND nx.d = c.d
  WHERE nx.id2 = c.head AND nx.d2 = 1),
walked AS (
  SELECT l.gid, false AS circular, l.head, l.pos, st.n AS node FROM lin l SEMI JOIN lin_ok k ON k.gid = l.gid AND k.head = l.head
  JOIN st ON st.gid = l.gid AND st.id = l.id AND st.d = l.d
  UNION ALL
  SELECT c.gid, true, c.head, c.pos, st.n FROM cyc c SEMI JOIN cyc_ok k ON k.gid = c.gid AND k.head = c.head
  JOIN st ON st.gid = c.gid AND st.id = c.id AND st.d = c.d)"""


CANON = """
arr AS (
  SELECT kar_id, walk_id, circular, list(node ORDER BY pos) AS a,
         list_reverse(list_transform(list(node ORDER BY pos), lambda v: -v)) AS b
  FROM steps GROUP BY kar_id, walk_id, circular),
canon AS (
  SELECT kar_id, walk_id, circular, CASE WHEN circular THEN least(
      list_min(list_transform(range(1, len(a) + 1), lambda k: a[k:len(a)] || a[1:k-1])),
      list_min(list_transform(range(1, len(b) + 1), lambda k: b[k:len(b)] || b[1:k-1]))) ELSE least(a, b) END AS c
  FROM arr)"""

SAMPLED = f"""
draws AS MATERIALIZED (
  SELECT gid, s AS sample, n, copy, "left", "right",
         {sql_draw(7, 's', 'gid', 'n', 'copy')} AS o
  FROM wiring CROSS JOIN range({SAMPLES}) r(s)),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY gid, sample, n ORDER BY o, copy) AS slot FROM draws),
sampled AS MATERIALIZED (
  SELECT l.gid, CAST(l.sample AS INTEGER) AS sample, l.n, l.copy, l."left", r."right"
  FROM ranked l JOIN ranked r ON l.gid = r.gid AND l.sample = r.sample AND l.n = r.n AND l.copy = r.slot)"""

SAMPLED_KARS = f"""
{SAMPLED},
gsampled AS (SELECT gid * {SAMPLES} + sample AS gid, n, copy, "left", "right" FROM sampled),
{walked('gsampled')},
wsteps AS (SELECT gid AS kar_id, circular::INT::VARCHAR || ':' || head AS walk_id, circular, pos, node FROM walked),
{CANON.replace('FROM steps', 'FROM wsteps')},
kars AS (
  SELECT kar_id // {SAMPLES} AS gid, kar_id % {SAMPLES} AS sample, count(*) AS walks, bool_or(circular) AS circ,
         list(c::VARCHAR || circular::VARCHAR ORDER BY c::VARCHAR || circular::VARCHAR)::VARCHAR AS k
  FROM canon GROUP BY kar_id)"""

#: The first of each distinct wiring among the samples of a graph (nodes of one copy have nothing to draw), and the first sample of each karyotype.
SATURATED = f"""
several AS MATERIALIZED (SELECT gid, n FROM wiring GROUP BY ALL HAVING count(*) > 1),
many AS MATERIALIZED (SELECT wiring.* FROM wiring SEMI JOIN several USING (gid, n)),
{SAMPLED.replace('FROM wiring CROSS JOIN range(4)', f'FROM many CROSS JOIN range({SATURATING[-1]})')},
pairings AS (SELECT gid, sample, list("right" ORDER BY n, copy) AS p FROM sampled GROUP BY ALL),
fresh AS MATERIALIZED (
  SELECT gid, min(sample) AS sample FROM pairings GROUP BY gid, p
  UNION ALL SELECT DISTINCT gid, 0 FROM wiring ANTI JOIN several USING (gid) WHERE gid IS NOT NULL),
gsampled AS MATERIALIZED (
  SELECT w.gid * {SATURATING[-1]} + f.sample AS gid, w.n, w.copy, w."left", CASE WHEN s.gid IS NULL THEN w."right" ELSE s."right" END AS "right"
  FROM wiring w JOIN fresh f ON f.gid = w.gid
  LEFT JOIN sampled s ON s.gid = w.gid AND s.sample = f.sample AND s.n = w.n AND s.copy = w.copy),
{walked('gsampled')},
wsteps AS (SELECT gid AS kar_id, circular::INT::VARCHAR || ':' || head AS walk_id, circular, pos, node FROM walked),
{CANON.replace('FROM steps', 'FROM wsteps')},
kars AS (
  SELECT kar_id // {SATURATING[-1]} AS gid, kar_id % {SATURATING[-1]} AS sample,
         list(c::VARCHAR || circular::VARCHAR ORDER BY c::VARCHAR || circular::VARCHAR)::VARCHAR AS k
  FROM canon GROUP BY kar_id),
firsts AS (SELECT gid, k, min(sample) AS s FROM kars GROUP BY gid, k)"""

MOVES = f"""
sizes AS (SELECT gid, n, count(*) AS cn FROM wiring GROUP BY ALL HAVING count(*) > 1),
ranges AS (SELECT *, sum(cn) OVER (PARTITION BY gid ORDER BY n) AS hi, sum(cn) OVER (PARTITION BY gid) AS total FROM sizes),
grid AS (
  SELECT gid, total, c AS chain, t AS step FROM (SELECT DISTINCT gid, total FROM ranges)
  CROSS JOIN range(2) a(c) CROSS JOIN range(1, 4) b(t)),
picked AS (SELECT *, {sql_draw(11, 'gid', 'chain', 'step')} % total + 1 AS pick FROM grid),
xy AS (
  SELECT p.gid, p.chain, p.step, r.n, r.cn, {sql_draw(12, 'p.gid', 'p.chain', 'p.step')} % r.cn + 1 AS x,
         {sql_draw(13, 'p.gid', 'p.chain', 'p.step')} % (r.cn - 1) + 1 AS y0
  FROM picked p JOIN ranges r ON r.gid = p.gid AND p.pick <= r.hi AND p.pick > r.hi - r.cn)"""


def _moved(out: str, src: str, step: int, attempt: str, attempts: int = AVOID_ATTEMPTS) -> str:
    """Every row of ``src`` after both moves of its chain at ``step``; ``attempt`` numbers the result within the chain."""
    return f"""
{out} AS MATERIALIZED (
  SELECT s.gid, s.chain, {attempt} AS t, s.n, s.copy, s."left", CASE WHEN p.gid IS NULL THEN s."right" ELSE p."right" END AS "right"
  FROM {src} s JOIN mv m ON m.gid = s.gid AND m.chain // {attempts} = s.chain AND m.step = {step}
  LEFT JOIN {src} p ON p.gid = s.gid AND p.chain = s.chain AND p.t = s.t AND p.n = s.n AND s.n = m.n
    AND p.copy = CASE s.copy WHEN m.a THEN m.b WHEN m.b THEN m.a END)"""


#: The states of two chains of three moves, and their walks.
CHAINING = f"""
{MOVES},
mv AS MATERIALIZED (
  SELECT gid, chain, step, n, least(x, y) AS a, greatest(x, y) AS b FROM (SELECT *, CASE WHEN y0 >= x THEN y0 + 1 ELSE y0 END AS y FROM xy)),
s0 AS MATERIALIZED (
  SELECT w.gid, c.chain, 0 AS t, w.n, w.copy, w."left", w."right" FROM wiring w JOIN (SELECT DISTINCT gid, chain FROM mv) c ON c.gid = w.gid),
{_moved('s1', 's0', 1, '1', 1)},
{_moved('s2', 's1', 2, '2', 1)},
{_moved('s3', 's2', 3, '3', 1)},
allw AS (
  SELECT (gid * 2 + chain) * 4 + t AS gid, n, copy, "left", "right"
  FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)),
{walked('allw')}"""

#: All states that two steps of two attempts can reach (1 + 2 + 4 a chain), their karyotypes, and the first unseen of each step.
AVOIDING = f"""
{MOVES.replace('range(2) a(c)', f'range({AVOID_CHAINS * AVOID_ATTEMPTS}) a(c)').replace('range(1, 4) b(t)', f'range(1, {AVOID_STEPS + 1}) b(t)')
      .replace(sql_draw(11, 'gid', 'chain', 'step'), sql_draw(AVOID_SEED, 'gid', 'chain', 'step'))
      .replace(sql_draw(12, 'p.gid', 'p.chain', 'p.step'), sql_draw(AVOID_SEED + 1, 'p.gid', 'p.chain', 'p.step'))
      .replace(sql_draw(13, 'p.gid', 'p.chain', 'p.step'), sql_draw(AVOID_SEED + 2, 'p.gid', 'p.chain', 'p.step'))},
mv AS MATERIALIZED (
  SELECT gid, chain, step, n, least(x, y) AS a, greatest(x, y) AS b FROM (SELECT *, CASE WHEN y0 >= x THEN y0 + 1 ELSE y0 END AS y FROM xy)),
sd AS MATERIALIZED (
  SELECT gid, s AS chain, n, copy, "left", "right", {sql_draw(AVOID_SEED + 3, 's', 'gid', 'n', 'copy')} AS o FROM wiring CROSS JOIN range({AVOID_CHAINS}) r(s)),
sr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY gid, chain, n ORDER BY o, copy) AS slot FROM sd),
t0 AS MATERIALIZED (
  SELECT l.gid, l.chain, 0 AS t, l.n, l.copy, l."left", r."right"
  FROM sr l JOIN sr r ON l.gid = r.gid AND l.chain = r.chain AND l.n = r.n AND l.copy = r.slot),
{_moved('t1', 't0', 1, '1 + m.chain % 2')},
{_moved('t2', 't1', 2, '3 + (s.t - 1) * 2 + m.chain % 2')},
allw AS (
  SELECT (gid * {AVOID_CHAINS} + chain) * 7 + t AS gid, n, copy, "left", "right"
  FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)),
{walked('allw')},
asteps AS MATERIALIZED (SELECT gid AS kar_id, circular::INT::VARCHAR || ':' || head AS walk_id, circular, pos, node FROM walked),
{CANON.replace('FROM steps', 'FROM asteps')},
tries AS MATERIALIZED (
  SELECT kar_id // {7 * AVOID_CHAINS} AS gid, CAST(kar_id // 7 % {AVOID_CHAINS} AS INTEGER) AS chain, kar_id % 7 AS t, count(*) AS walks,
         sum(circular::INT) AS rings, sum(len(c)) AS rows, list(c::VARCHAR || circular::VARCHAR ORDER BY c::VARCHAR || circular::VARCHAR)::VARCHAR AS k
  FROM canon GROUP BY kar_id),
p0 AS (SELECT * FROM tries WHERE t = 0),
p1 AS (SELECT x.gid, x.chain, min(x.t) AS t FROM tries x JOIN p0 USING (gid, chain) WHERE x.t IN (1, 2) AND x.k <> p0.k GROUP BY ALL),
p2 AS (
  SELECT x.gid, x.chain, min(x.t) AS t FROM tries x JOIN p0 USING (gid, chain) JOIN p1 USING (gid, chain)
  JOIN tries y ON y.gid = p1.gid AND y.chain = p1.chain AND y.t = p1.t
  WHERE x.t IN (3 + (p1.t - 1) * 2, 4 + (p1.t - 1) * 2) AND x.k <> p0.k AND x.k <> y.k GROUP BY ALL),
taken AS (SELECT gid, chain, 0 AS t, 0 AS step FROM p0 UNION ALL SELECT gid, chain, t, 1 FROM p1 UNION ALL SELECT gid, chain, t, 2 FROM p2)"""


def _with(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(ctes)


QUERIES = {
    "genome_nodes": (genome_nodes, _with(GENOME) +
        ' SELECT node_id, seqnames, s AS "start", e AS "end", width, cn FROM genome'),
    "graph_nodes": (graph_nodes, _with(CUSTOMER_STEPS) +
        " SELECT kar_id, abs(node) AS node_id, count(*) AS cn FROM steps GROUP BY ALL"),
    "graph_edges": (graph_edges, _with(CUSTOMER_STEPS, NXT, _edges("kar_id,")) + " SELECT * FROM edges"),
    "population_edges": (population_edges, _with(CUSTOMER_STEPS, NXT, _edges("")) + " SELECT * FROM edges"),
    "loose_ends": (loose_ends, _with(CUSTOMER_STEPS.replace("o_custkey AS kar_id", "0 AS kar_id"), NXT, _edges("kar_id,"), LOOSE) +
        " SELECT node_id, side AS orientation, node_cn, cn FROM loose"),
    "external_edges": (external_edges, _with(CUSTOMER_STEPS, NXT, EXTERNAL) + " SELECT * FROM ext"),
    "wiring": (wiring, _with(CUSTOMER_STEPS, NXT, WIRING) +
        ' SELECT gid AS kar_id, n, copy, "left", "right" FROM wiring'),
    "smoothed_cn": (smoothed_cn, _with(CUSTOMER_STEPS, NXT, _edges("")) + """,
        delta AS (
          SELECT n1 AS node_id, -cn AS d FROM edges WHERE n1 = n2 AND n1_side <> n2_side
          UNION ALL SELECT (n1 + n2) // 2, cn FROM edges
          WHERE type = 'ALT' AND n2 - n1 = 2 AND n1_side = 'right' AND n2_side = 'left')
        SELECT node_id, cn, CAST(cn + coalesce((SELECT sum(d) FROM delta WHERE delta.node_id = x.node_id), 0) AS BIGINT) AS cn_smooth
        FROM (SELECT abs(node) AS node_id, count(*) AS cn FROM steps GROUP BY ALL) x"""),
    "walks_from_wiring": (walks_from_wiring, _with(CUSTOMER_STEPS, NXT, WIRING, walked("wiring"), recursive=True) + """
        SELECT gid, CAST(dense_rank() OVER (PARTITION BY gid ORDER BY circular, head) - 1 AS INTEGER) AS walk, circular,
               CAST(pos AS BIGINT) AS pos, count(*) OVER (PARTITION BY gid, circular, head) AS n, node FROM walked"""),
    "canonical_steps": (canonical_steps, _with(ORDER_STEPS, CANON) +
        " SELECT walk_id, CAST(k AS BIGINT) AS pos, c[k] AS node FROM (SELECT walk_id, c, unnest(range(1, len(c) + 1)) AS k FROM canon)"),
    "walk_classes": (walk_classes, _with(CUSTOMER_STEPS, CANON) + """
        SELECT walk_id, min(walk_id) OVER (PARTITION BY circular, c) AS rep_id,
               count(*) OVER (PARTITION BY circular, c) AS members FROM canon"""),
    "karyotype_classes": (karyotype_classes, _with(ORDER_STEPS, CANON) + """,
        kar AS (SELECT kar_id, list(c::VARCHAR || circular::VARCHAR ORDER BY c::VARCHAR || circular::VARCHAR) AS k
                FROM canon GROUP BY kar_id)
        SELECT kar_id, min(kar_id) OVER (PARTITION BY k) AS rep_id, count(*) OVER (PARTITION BY k) AS members FROM kar"""),
    "unique_circular_walks": (unique_circular_walks, _with(CUSTOMER_STEPS, CANON) +
        " SELECT min(walk_id) AS walk_id, CAST(len(c) AS BIGINT) AS n, count(*) AS members FROM canon WHERE circular GROUP BY c"),
    "linear_karyotypes": (linear_karyotypes, _with(ORDER_STEPS) + """
        SELECT kar_id, count(DISTINCT walk_id) AS walks, count(*) AS steps FROM steps
        GROUP BY kar_id HAVING NOT bool_or(circular)"""),
    "sampled_wirings": (sampled_wirings, _with(CUSTOMER_STEPS, NXT, WIRING, SAMPLED) + " SELECT * FROM sampled"),
    "sampled_karyotypes": (sampled_karyotypes, _with(CUSTOMER_STEPS, NXT, WIRING, SAMPLED_KARS, recursive=True) +
        " SELECT gid, CAST(min(sample) AS INTEGER) AS sample, walks, circ FROM kars GROUP BY gid, walks, circ, k"),
    "saturation": (saturation, _with(CUSTOMER_STEPS, NXT, WIRING, SATURATED, recursive=True) + f"""
        SELECT gid, {', '.join(f'count(*) FILTER (s < {n}) AS n{n}' for n in SATURATING)}
        FROM firsts GROUP BY gid"""),
    "markov_moves": (markov_moves, _with(CUSTOMER_STEPS, NXT, WIRING, MOVES) + """
        SELECT gid, CAST(chain AS INTEGER) AS chain, CAST(step AS INTEGER) AS step, n, least(x, y) AS a, greatest(x, y) AS b
        FROM (SELECT *, CASE WHEN y0 >= x THEN y0 + 1 ELSE y0 END AS y FROM xy)"""),
    "markov_chains": (markov_chains, _with(CUSTOMER_STEPS, NXT, WIRING, CHAINING, recursive=True) + """
        SELECT gid // 8 AS gid, CAST(gid // 4 % 2 AS INTEGER) AS chain, CAST(gid % 4 AS INTEGER) AS step, count(*) AS walks,
               CAST(sum(circular::INT) AS BIGINT) AS rings, CAST(sum(n) AS BIGINT) AS rows
        FROM (SELECT gid, circular, head, count(*) AS n FROM walked GROUP BY ALL) GROUP BY gid"""),
    "self_avoiding_chains": (self_avoiding_chains, _with(CUSTOMER_STEPS, NXT, WIRING, AVOIDING, recursive=True) + """
        SELECT t.gid, t.chain, CAST(t.step AS INTEGER) AS step, x.walks, CAST(x.rings AS BIGINT) AS rings, CAST(x.rows AS BIGINT) AS rows
        FROM taken t JOIN tries x ON x.gid = t.gid AND x.chain = t.chain AND x.t = t.t"""),
}

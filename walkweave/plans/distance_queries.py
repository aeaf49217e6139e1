"""Registered queries over k-mers, read words and distances between karyotypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from walkweave.functions.rand import sql_uniform
from walkweave.operators import contact as K
from walkweave.operators import distance as D
from walkweave.operators import intervals as I
from walkweave.operators import lists as LI
from walkweave.operators import reads as R
from walkweave.plans import tables as T
from walkweave.plans.contact_queries import HALVES, placed_sql
from walkweave.plans.graph_queries import CANON
from walkweave.plans.oracle import CUSTOMER_STEPS, GENOME, ORDER_STEPS, PAIRS
from walkweave.session import cut
from walkweave.sources.calibration import INTERCHROM_DENSITY

LENGTH = 30_000
DEPTH = 10
AREA0 = 1e8
DRAW_SETS = 20


def kmer_counts(spark, sf):
    return R.kmers(T.customer_walks(spark, sf).df, 3).select("kmer", "count")


def kmer_pairs(spark, sf):
    """Adjacent pairs per karyotype."""
    return R.kmers(T.order_walks(spark, sf).df, 2, ["kar_id"]).select("kar_id", "kmer", "count")


def minimal_read_length(spark, sf):
    pairs, lists, _, _ = _lists(spark, sf)

    def rows(some):
        walks = T.order_walks(spark, sf)
        return R.minimal_read_length(some, cut(walks.df), T.genome(spark, sf), split=walks.split, bound=walks.longest)

    return R.listed_read_length(pairs, lists, rows)


def _words(spark, sf):
    walks = T.order_walks(spark, sf)
    return R.read_words(walks.df, T.genome(spark, sf), LENGTH, split=walks.split)


def read_words(spark, sf):
    return _words(spark, sf)


def population_words(spark, sf):
    walks = T.customer_walks(spark, sf)
    return R.read_words(walks.df, T.genome(spark, sf), LENGTH, by=[], split=walks.split)


def _reads(spark, sf, depth):
    size = T.genome(spark, sf).agg(F.sum("width")).first()[0]
    return R.read_count(size, LENGTH, depth)


def _lists(spark, sf):
    """Karyotypes as lists, and the joint vocabulary of the pairs of those that are too large."""
    lists = LI.karyotype_lists(LI.word_steps(T.order_walks(spark, sf).df, T.genome(spark, sf)), F.expr(LI.WORD_ITEM))
    return T.order_pairs(spark, sf), lists, lambda some: R.pair_words(some, _words(spark, sf)), LENGTH


def longread_kl(spark, sf, shared=None):
    kl = R.listed_longread_kl(*(shared or _lists(spark, sf)), _reads(spark, sf, 1))
    return kl.withColumn("longread", F.round("longread", 5))


def call_longreads(spark, sf):
    """Every read that the first karyotype can show, as often as it shows it."""
    called = R.listed_calls(*_lists(spark, sf), background=1e-3)
    return called.withColumn("llr", F.round("llr", 3))


def read_separability(spark, sf):
    return R.listed_separability(*_lists(spark, sf), int(_reads(spark, sf, 1)), DRAW_SETS, seed=3, background=1e-3)


def aligned_walks(spark, sf):
    """Alignment cost of each walk with the walk of the same flag in the next order of its customer."""
    source = T.order_walks(spark, sf)
    walks = D.weighted_walks(source.df, T.genome(spark, sf), bound=source.longest).withColumn("flag", F.col("walk_id") % 3)
    pairs = T.order_pairs(spark, sf)
    a = pairs.join(walks.select(F.col("kar_id").alias("kar_a"), "flag", F.col("nodes").alias("x"), F.col("ws").alias("w"), F.col("total").alias("wx")), "kar_a")
    b = walks.select(F.col("kar_id").alias("kar_b"), "flag", F.col("nodes").alias("y"), F.col("total").alias("wy"))
    return D.aligned_cost(a.join(b, ["kar_b", "flag"]).drop("kar_a", "kar_b"))


def _edit(spark, sf, unit=False, shared=None):
    pairs, lists, _, _ = shared or _lists(spark, sf)

    def rows(some):
        walks = T.order_walks(spark, sf)
        return D.edit_distance(some, walks.df, T.genome(spark, sf), bound=walks.longest, unit=unit)

    return D.listed_edit(pairs, lists, rows, unit=unit)


def edit_distance(spark, sf):
    return _edit(spark, sf)


def edit_distance_unit(spark, sf):
    return _edit(spark, sf, unit=True)


def _pixels(spark, sf):
    walks, nodes = T.order_walks(spark, sf), T.genome(spark, sf)
    return K.small_pixels(walks.df, nodes, I.half_nodes(nodes), "kar_id", split=walks.split, longest=walks.longest)


def contact_kl(spark, sf):
    walks, nodes = T.order_walks(spark, sf), T.genome(spark, sf)
    half = I.half_nodes(nodes)
    lists = D.contact_lists(walks.df, nodes, half, split=walks.split)
    pixels = lambda: K.walk_pixels(walks.df, nodes, half, ["kar_id"], split=walks.split, longest=walks.longest)
    rows = lambda some: D.contact_kl(some, pixels(), half, DEPTH, area0=AREA0)
    kl = D.listed_contact_kl(T.order_pairs(spark, sf), lists, rows, DEPTH, area0=AREA0)
    return kl.withColumn("hic", F.round("hic", 5))


def pair_distances(spark, sf):
    """All three distances side by side."""
    shared = _lists(spark, sf)
    out = contact_kl(spark, sf).join(_edit(spark, sf, shared=shared), "pair_id")
    return out.join(longread_kl(spark, sf, shared), "pair_id", "left")


def region_kl(spark, sf):
    """All pairs of regions, a region being all walks of its nations' customers."""
    walks = T.customer_walks(spark, sf)
    cust = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("kar_id"), F.col("c_nationkey").alias("n_nationkey"))
    region = T.read(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("region"))
    nodes = T.genome(spark, sf)
    member = cust.join(region, "n_nationkey").select("kar_id", "region")
    steps = walks.df.join(member, "kar_id")
    half = I.half_nodes(nodes)
    pixels = K.walk_pixels(steps, nodes, half, ["region"], split=walks.split, longest=walks.longest)
    pairs = D.all_pairs(region.select("region").distinct(), "region")
    kl = D.contact_kl(pairs, pixels, half, DEPTH, area0=AREA0, kar="region")
    full = D.complete_matrix(pairs.join(kl, "pair_id").withColumn("hic", F.round("hic", 1)), ["hic"])
    return full.withColumn("scaled", F.round("scaled", 6))


# ---- oracle text -------------------------------------------------------------------------------

ARR = """
arr AS (SELECT kar_id, walk_id, circular, list(node ORDER BY pos) AS a, count(*) AS n FROM steps GROUP BY ALL)"""


def _windows(k: str, src: str = "arr") -> str:
    return f"""
  SELECT kar_id, k, (a || a)[p:p + k - 1] AS w FROM (
    SELECT *, unnest(range(1, CASE WHEN circular AND k <= n + 1 THEN n + 1 ELSE n - k + 2 END)) AS p
    FROM {src} CROSS JOIN {k})"""


def _kmers(k: str) -> str:
    return f"""{ARR},
win AS ({_windows(k)}),
km AS (SELECT kar_id, k, w FROM win UNION ALL SELECT kar_id, k, list_reverse(list_transform(w, lambda v: -v)) FROM win)"""


def _text(col: str) -> str:
    return f"array_to_string(list_transform({col}, lambda v: v::VARCHAR), '|')"


WORDS = f"""
crd AS (
  SELECT s.*, CAST(sum(width) OVER w AS BIGINT) AS e, CAST(sum(width) OVER w - width + 1 AS BIGINT) AS st,
         CAST(sum(width) OVER (PARTITION BY walk_id) AS BIGINT) AS len
  FROM steps s JOIN genome g ON g.node_id = abs(s.node) WINDOW w AS (PARTITION BY walk_id ORDER BY pos)),
dom AS (
  SELECT DISTINCT kar_id, walk_id, circular, len, CASE WHEN circular THEN least({LENGTH}, len) ELSE {LENGTH} END AS r,
         CASE WHEN circular THEN 1 ELSE 2 - {LENGTH} END AS lo, len AS hi FROM crd),
laps AS (
  SELECT c.walk_id, c.pos, c.node, c.st, c.e FROM crd c
  UNION ALL
  SELECT c.walk_id, c.pos + c.n, c.node, c.st + c.len, least(c.e + c.len, c.len + d.r - 1)
  FROM crd c JOIN dom d USING (walk_id) WHERE c.circular AND c.st + c.len <= c.len + d.r - 1),
cuts AS (
  SELECT walk_id, lo AS c FROM dom UNION SELECT walk_id, hi + 1 FROM dom
  UNION SELECT l.walk_id, l.st - d.r + 1 FROM laps l JOIN dom d USING (walk_id)
  UNION SELECT walk_id, e + 1 FROM laps),
bins AS (
  SELECT c.walk_id, c.c, lead(c.c) OVER (PARTITION BY c.walk_id ORDER BY c.c) AS nx, d.r, d.kar_id
  FROM cuts c JOIN dom d USING (walk_id) WHERE c.c BETWEEN d.lo AND d.hi + 1),
shown AS (
  SELECT b.kar_id, b.walk_id, b.c, b.nx - b.c AS m, list(l.node ORDER BY l.pos) AS w
  FROM bins b JOIN laps l ON l.walk_id = b.walk_id AND l.st <= b.c + b.r - 1 AND b.c <= l.e
  WHERE b.nx IS NOT NULL GROUP BY ALL),
wordrows AS (
  SELECT kar_id, {_text('w')} AS word, m FROM shown
  UNION ALL SELECT kar_id, {_text('list_reverse(list_transform(w, lambda v: -v))')}, m FROM shown),
words AS (SELECT kar_id, word, CAST(sum(m) AS BIGINT) AS nums FROM wordrows GROUP BY ALL)"""

PAIR_WORDS = f"""{WORDS}, {PAIRS},
pw AS (
  SELECT pair_id, word, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM (
    SELECT pair_id, word, nums AS a, 0 AS b FROM pairs JOIN words ON kar_id = kar_a
    UNION ALL SELECT pair_id, word, 0, nums FROM pairs JOIN words ON kar_id = kar_b) GROUP BY ALL)"""


def _probs(bg: float) -> str:
    return f"""
tot AS (SELECT pair_id, sum(a) + {bg!r}::DOUBLE * count(*) AS ta, sum(b) + {bg!r}::DOUBLE * count(*) AS tb FROM pw GROUP BY pair_id),
pq AS (SELECT pair_id, word, a AS ca, (a + {bg!r}::DOUBLE) / ta AS p, (b + {bg!r}::DOUBLE) / tb AS q FROM pw JOIN tot USING (pair_id))"""


KL_LR = f"""
lr AS (SELECT pair_id, round((SELECT sum(width) + {2 * LENGTH} FROM genome)::DOUBLE / {LENGTH} * sum(p * ln(p / q)), 5) AS longread
       FROM pq GROUP BY pair_id)"""


def _lcs(unit: bool) -> str:
    """Alignment cost ``cost(xid, yid, cost)`` for the rows of ``ask(xid, yid)`` over ``arrw``."""
    w = "1.0::DOUBLE" if unit else "g.width::DOUBLE"
    return f"""
{CANON.replace('arr AS', 'carr AS').replace('FROM arr', 'FROM carr')},
opened AS (
  SELECT kar_id, walk_id, k AS pos, q[k] AS node FROM (
    SELECT kar_id, walk_id, CASE WHEN circular THEN c ELSE (SELECT any_value(a) FROM carr x WHERE x.walk_id = canon.walk_id) END AS q,
           unnest(range(1, len(c) + 1)) AS k FROM canon)),
arrw AS (
  SELECT kar_id, walk_id, list(node ORDER BY pos) AS a, list({w} ORDER BY pos) AS w, sum({w}) AS total
  FROM opened s JOIN genome g ON g.node_id = abs(s.node) GROUP BY kar_id, walk_id),
strands AS (
  SELECT xid, yid, x.a AS x, x.w AS w, y.a AS y, 1 AS st FROM ask JOIN arrw x ON x.walk_id = xid JOIN arrw y ON y.walk_id = yid
  UNION ALL
  SELECT xid, yid, x.a, x.w, list_reverse(list_transform(y.a, lambda v: -v)), 2 FROM ask JOIN arrw x ON x.walk_id = xid JOIN arrw y ON y.walk_id = yid),
dp AS (
  SELECT xid, yid, st, x, w, y, 0 AS i, list_transform(range(len(y) + 1), lambda k: 0.0::DOUBLE) AS best FROM strands
  UNION ALL
  SELECT xid, yid, st, x, w, y, i + 1, list_transform(cand, lambda v, k: list_max(cand[1:k])) FROM (
    SELECT *, [0.0::DOUBLE] || list_transform(range(1, len(y) + 1), lambda j:
      greatest(best[j + 1], best[j] + CASE WHEN x[i + 1] = y[j] THEN w[i + 1] ELSE 0.0::DOUBLE END)) AS cand
    FROM dp WHERE i < len(x))),
cost AS (
  SELECT xid, yid, max(best[len(y) + 1]) AS common FROM dp WHERE i = len(x) GROUP BY xid, yid)"""


def _edit_sql(unit: bool) -> str:
    """Six assignments of at most three walks a side (missing walks are empty)."""
    cell = lambda i, j: (f"coalesce(max(c) FILTER (fa = {i} AND fb = {j}), 0)")
    cells = ", ".join(f"{cell(i, j)} AS c{i}{j}" for i in range(3) for j in range(3))
    perms = ("c00+c11+c22", "c00+c12+c21", "c01+c10+c22", "c01+c12+c20", "c02+c10+c21", "c02+c11+c20")
    return f"""WITH RECURSIVE {GENOME}, {ORDER_STEPS}, {PAIRS},
ids AS (SELECT DISTINCT kar_id, walk_id FROM steps),
ask AS (SELECT DISTINCT x.walk_id AS xid, y.walk_id AS yid FROM pairs p JOIN ids x ON x.kar_id = p.kar_a JOIN ids y ON y.kar_id = p.kar_b),
{_lcs(unit)},
grid AS (SELECT pair_id, kar_a * 3 + fa AS xid, kar_b * 3 + fb AS yid, fa, fb FROM pairs CROSS JOIN range(3) r(fa) CROSS JOIN range(3) s(fb)),
cellv AS (
  SELECT g.pair_id, fa, fb, coalesce(x.total, 0) + coalesce(y.total, 0) - 2 * coalesce(common, 0) AS c
  FROM grid g LEFT JOIN arrw x ON x.walk_id = g.xid LEFT JOIN arrw y ON y.walk_id = g.yid
  LEFT JOIN cost k ON k.xid = g.xid AND k.yid = g.yid),
mat AS (SELECT pair_id, {cells} FROM cellv GROUP BY pair_id),
edit AS (SELECT pair_id, least({', '.join(perms)}) AS edit FROM mat)"""


def _kl(a: str, b: str) -> str:
    a, b = f"greatest({a}, 1e-10)", f"greatest({b}, 1e-10)"
    return f"greatest(0, {a} * ln({a} / {b}) + (2 + {a}) * ln((2 + {b}) / (2 + {a})))"


def _hic(key: str, pairs: str = "pairs") -> str:
    return f"""
union_px AS (
  SELECT pair_id, i, j, sum(a) AS a, sum(b) AS b FROM (
    SELECT pair_id, i, j, v AS a, 0 AS b FROM {pairs} JOIN intra ON {key} = kar_a
    UNION ALL SELECT pair_id, i, j, 0, v FROM {pairs} JOIN intra ON {key} = kar_b) GROUP BY ALL),
mu AS (
  SELECT pair_id, (x.e - x.s + 1)::DOUBLE * (y.e - y.s + 1) AS area,
         (a + (x.e - x.s + 1)::DOUBLE * (y.e - y.s + 1) * {INTERCHROM_DENSITY!r}::DOUBLE * (x.cn * y.cn)) * {DEPTH / 2!r}::DOUBLE AS ma,
         (b + (x.e - x.s + 1)::DOUBLE * (y.e - y.s + 1) * {INTERCHROM_DENSITY!r}::DOUBLE * (x.cn * y.cn)) * {DEPTH / 2!r}::DOUBLE AS mb
  FROM union_px JOIN halves x ON x.tile_id = i JOIN halves y ON y.tile_id = j),
hic AS (SELECT p.pair_id, coalesce(sum(area / {AREA0!r}::DOUBLE * {_kl('ma', 'mb')}), 0) AS hic FROM {pairs} p LEFT JOIN mu USING (pair_id) GROUP BY p.pair_id)"""


HIC = f"{HALVES}, {placed_sql('halves', by='kar_id,')}, {_hic('kar_id')}"

QUERIES = {
    "kmer_counts": (kmer_counts, f"""WITH {CUSTOMER_STEPS}, {_kmers('(VALUES (3)) v(k)')}
        SELECT {_text('w')} AS kmer, count(*) AS count FROM km GROUP BY w"""),
    "kmer_pairs": (kmer_pairs, f"""WITH {ORDER_STEPS}, {_kmers('(VALUES (2)) v(k)')}
        SELECT kar_id, {_text('w')} AS kmer, count(*) AS count FROM km GROUP BY kar_id, w"""),
    "minimal_read_length": (minimal_read_length, f"""WITH {GENOME}, {ORDER_STEPS}, {PAIRS}, {_kmers('range(3, 16) v(k)')},
        cnt AS (SELECT kar_id, k, w, count(*) AS c FROM km GROUP BY ALL),
        diff AS (
          SELECT pair_id, k, w FROM (
            SELECT pair_id, k, w, c FROM pairs JOIN cnt ON kar_id = kar_a
            UNION ALL SELECT pair_id, k, w, -c FROM pairs JOIN cnt ON kar_id = kar_b) GROUP BY ALL HAVING sum(c) <> 0),
        first AS (SELECT pair_id, min(k) AS k FROM diff GROUP BY pair_id),
        inner_w AS (
          SELECT d.pair_id, d.k, d.w, sum(g.width) AS width
          FROM (SELECT pair_id, k, w, unnest(w[2:k-1]) AS v FROM diff SEMI JOIN first USING (pair_id, k)) d
          JOIN genome g ON g.node_id = abs(d.v) GROUP BY ALL)
        SELECT p.pair_id, CAST(max(k) AS INTEGER) AS k, CAST(min(width) AS BIGINT) AS width
        FROM pairs p LEFT JOIN inner_w USING (pair_id) GROUP BY p.pair_id"""),
    "read_words": (read_words, f"WITH {GENOME}, {ORDER_STEPS}, {WORDS} SELECT kar_id, word, nums FROM words"),
    "population_words": (population_words, f"""WITH {GENOME}, {CUSTOMER_STEPS}, {WORDS}
        SELECT word, CAST(sum(nums) AS BIGINT) AS nums FROM words GROUP BY word"""),
    "longread_kl": (longread_kl, f"WITH {GENOME}, {ORDER_STEPS}, {PAIR_WORDS}, {_probs(1e-5)}, {KL_LR} SELECT pair_id, longread FROM lr"),
    "call_longreads": (call_longreads, f"""WITH {GENOME}, {ORDER_STEPS}, {PAIR_WORDS}, {_probs(1e-3)},
        ll AS (SELECT pair_id, sum(ca * ln(p / q)) AS llr FROM pq WHERE ca > 0 GROUP BY pair_id)
        SELECT pair_id, round(llr, 3) AS llr, CASE WHEN llr > 0 THEN 'a' WHEN llr < 0 THEN 'b'
               WHEN {sql_uniform(1, 'pair_id')} < 0.5 THEN 'a' ELSE 'b' END AS called FROM ll"""),
    "read_separability": (read_separability, f"""WITH {GENOME}, {ORDER_STEPS}, {PAIR_WORDS}, {_probs(1e-3)},
        sides AS (SELECT pair_id, word, ln(p / q) AS llr, s AS source, CASE WHEN s = 0 THEN p ELSE q END AS w FROM pq CROSS JOIN range(2) r(s)),
        spans AS (
          SELECT pair_id, source, llr, coalesce(sum(w) OVER (PARTITION BY pair_id, source ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
                 CASE WHEN lead(word) OVER (PARTITION BY pair_id, source ORDER BY word) IS NULL THEN 1.0::DOUBLE
                      ELSE sum(w) OVER (PARTITION BY pair_id, source ORDER BY word ROWS UNBOUNDED PRECEDING) END AS hi FROM sides),
        draws AS (
          SELECT pair_id, s AS source, t AS sample, {sql_uniform(3, 'pair_id', 's', 't', 'd')} AS u
          FROM (SELECT DISTINCT pair_id FROM pw) CROSS JOIN range(2) a(s) CROSS JOIN range(1, {DRAW_SETS + 1}) b(t) CROSS JOIN (SELECT unnest(range(1, CAST(floor((sum(width) + 2 * {LENGTH}) / {LENGTH}::DOUBLE) AS INTEGER) + 1)) AS d FROM genome) c),
        rat AS (
          SELECT d.pair_id, d.source, d.sample, sum(llr) AS llr FROM draws d
          ASOF JOIN spans x ON x.pair_id = d.pair_id AND x.source = d.source AND d.u >= x.lo GROUP BY ALL)
        SELECT pair_id, avg(CASE WHEN source = 0 THEN (llr <= 0)::INT ELSE (llr >= 0)::INT END) AS error_rate FROM rat GROUP BY pair_id"""),
    "aligned_walks": (aligned_walks, f"""WITH RECURSIVE {GENOME}, {ORDER_STEPS}, {PAIRS},
        ids AS (SELECT DISTINCT kar_id, walk_id FROM steps),
        ask AS (SELECT DISTINCT x.walk_id AS xid, y.walk_id AS yid FROM pairs p JOIN ids x ON x.kar_id = p.kar_a
                JOIN ids y ON y.kar_id = p.kar_b AND y.walk_id % 3 = x.walk_id % 3),
        {_lcs(False)}
        SELECT pair_id, xid % 3 AS flag, x.total + y.total - 2 * common AS cost
        FROM pairs JOIN arrw x ON x.kar_id = kar_a JOIN arrw y ON y.kar_id = kar_b JOIN cost ON xid = x.walk_id AND yid = y.walk_id"""),
    "edit_distance": (edit_distance, f"{_edit_sql(False)} SELECT pair_id, edit FROM edit"),
    "edit_distance_unit": (edit_distance_unit, f"{_edit_sql(True)} SELECT pair_id, edit FROM edit"),
    "contact_kl": (contact_kl, f"WITH {GENOME}, {ORDER_STEPS}, {PAIRS}, {HIC} SELECT pair_id, round(hic, 5) AS hic FROM hic"),
    "pair_distances": (pair_distances, f"""{_edit_sql(False)}, {HIC.replace('crd', 'hcrd')},
        {PAIR_WORDS.replace(PAIRS + ',', '').replace('crd', 'wcrd')}, {_probs(1e-5)}, {KL_LR}
        SELECT e.pair_id, round(hic, 5) AS hic, edit, longread FROM edit e JOIN hic USING (pair_id) LEFT JOIN lr USING (pair_id)"""),
    "region_kl": (region_kl, f"""WITH {GENOME}, {HALVES},
        {CUSTOMER_STEPS.replace('steps AS', 'csteps AS')},
        steps AS (SELECT c.* REPLACE (CAST(n_regionkey AS BIGINT) AS kar_id) FROM csteps c JOIN customer ON c_custkey = kar_id
                  JOIN nation ON n_nationkey = c_nationkey),
        {placed_sql('halves', by='kar_id,')},
        regs AS (SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS r FROM nation),
        rp AS (SELECT a.r * 100 + b.r AS pair_id, a.r AS kar_a, b.r AS kar_b FROM regs a JOIN regs b ON a.r < b.r),
        {_hic('kar_id', 'rp')},
        d AS (SELECT kar_a, kar_b, round(hic, 1) AS hic FROM hic JOIN rp USING (pair_id)),
        f AS (SELECT * FROM d UNION ALL SELECT kar_b, kar_a, hic FROM d UNION ALL SELECT r, r, 0 FROM regs)
        SELECT kar_a, kar_b, 'hic' AS metric, hic AS value, round(hic / max(hic) OVER (), 6) AS scaled FROM f"""),
}

"""Registered queries comparing simulated and observed maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from walkweave.functions.rand import sql_uniform
from walkweave.operators import contact as K
from walkweave.operators import intervals as I
from walkweave.operators import likelihood as L
from walkweave.plans import tables as T
from walkweave.plans.contact_queries import BIN, NODE_TILES, _node_tiles, compartment_ranges, map_sql, placed_sql
from walkweave.plans.oracle import CONTACTS, CUSTOMER_STEPS, GENOME
from walkweave.session import cut

DEPTH = 2
AREA0 = 1e9
SAMPLES = 20
SIGNIFICANCE = 0.05
F1_SAMPLES = int(4 / SIGNIFICANCE)


def node_map(spark, sf, which: str = "true"):
    """Simulated map with one tile per segment; ``which`` filters the walks."""
    walks, nodes = T.customer_walks(spark, sf), T.genome(spark, sf)
    return K.simulate(walks.df.filter(which), nodes, _node_tiles(spark, sf), DEPTH, split=walks.split, longest=walks.longest)


def _aligned(spark, sf):
    expected = node_map(spark, sf)
    return L.align(T.contacts(spark, sf), expected, expected)


def _pair(spark, sf):
    """Maps of circular (a) and linear (b) walks side by side."""
    a = node_map(spark, sf, "circular").select("i", "j", "widthprod", F.col("value").alias("a"))
    b = node_map(spark, sf, "NOT circular").select("i", "j", F.col("value").alias("b"))
    return a.join(b, ["i", "j"])


def nll_pixels(spark, sf):
    return L.compare_pixels(_aligned(spark, sf), 2, area0=AREA0).withColumn("value", F.round("value", 7))


def nll_scores(spark, sf):
    """Total score by noise model, with and without the diagonal."""
    rows = _aligned(spark, sf)
    models = (("nb2", 2, True), ("nb2_offdiag", 2, False), ("nb3.5", 3.5, True), ("poisson", 0, True))
    area, x, mu = F.col("widthprod"), F.col("x"), F.col("mu")
    keep = lambda diag, v: v if diag else F.when(F.col("i") != F.col("j"), v)
    scored = rows.agg(*[
        F.sum(keep(diag, L.pixel_score(x, mu, area, theta, AREA0))).alias(name) for name, theta, diag in models])
    names = [m[0] for m in models]
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.round(F.col(f"`{n}`"), 1).alias("value")) for n in names])
    return scored.select(F.explode(pairs).alias("r")).select("r.model", "r.value")


def nll_masked(spark, sf):
    """Segments touching an A compartment are masked when both ends are in it."""
    a = compartment_ranges(spark, sf).filter("compartment = 'A'").select("seqnames", "start", "end")
    masked = I.overlap_semi(_node_tiles(spark, sf), a, BIN, "tile_id").select("tile_id")
    both = L.compare_pixels(_aligned(spark, sf), 2, area0=AREA0, masked=masked)
    return both.groupBy((F.col("value") == 0).alias("zero")).agg(
        F.count(F.lit(1)).alias("pixels"), F.round(F.sum("value"), 2).alias("value"))


def kl_maps(spark, sf):
    pair = _pair(spark, sf).withColumns({"x": F.col("a"), "mu": F.col("b")})
    return L.compare_pixels(pair, 2, kl=True, area0=AREA0).withColumn("value", F.round("value", 7))


def noisy_maps(spark, sf):
    return L.noisy_maps(node_map(spark, sf), 3, 2, seed=5).select("map_id", "i", "j", "value")


def noisy_poisson(spark, sf):
    """Mean and variance over the pixels of Poisson resamples (no SQL counterpart for the draws)."""
    base = node_map(spark, sf).withColumn("mean", F.col("value"))
    drawn = L.noisy_maps(base, 3, 0, seed=5)
    return drawn.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.round(F.sum("value") / F.sum("mean"), 6).alias("ratio"))


def separability(spark, sf):
    pair = cut(_pair(spark, sf))
    return L.separability_error(L.sample_ratios(pair, SAMPLES, 2, seed=9, area0=AREA0))


def f1_maps(spark, sf):
    pair = cut(_pair(spark, sf))
    ratios = L.sample_ratios(pair, F1_SAMPLES, 2, seed=9, area0=AREA0)
    return L.f1_score(ratios, SIGNIFICANCE, F1_SAMPLES).select(
        F.round("cutoff", 3).alias("cutoff"), F.col("tp").cast("long").alias("tp"), F.col("fn").cast("long").alias("fn"),
        F.round("f1", 9).alias("f1"))


def loops(spark, sf):
    called = L.call_loops(node_map(spark, sf), T.contacts(spark, sf), 0.05)
    return called.withColumns({"logoe": F.round("logoe", 8), "neglogp": F.round("neglogp", 6)})


def loops_all(spark, sf):
    called = L.call_loops(node_map(spark, sf), T.contacts(spark, sf), 0.05, mode="all")
    return called.withColumns({"logoe": F.round("logoe", 8), "neglogp": F.round("neglogp", 6)})


def qq_data(spark, sf):
    """QQ data of the loop p-values."""
    tested = L.loop_pvalues(node_map(spark, sf), T.contacts(spark, sf)).select(F.round("p", 12).alias("p"))
    return L.qq_points(tested).withColumn("expected", F.round("expected", 12))


def depth_ratio(spark, sf):
    return L.depth_ratio(T.contacts(spark, sf)).withColumn("depth", F.round("depth", 9))


# ---- oracle text -------------------------------------------------------------------------------


def _map(which: str, suffix: str) -> str:
    """CTEs of the segment map of the walks that satisfy ``which``; the map is called ``map{suffix}``."""
    text = f"{placed_sql('ntiles')}, {map_sql('ntiles', depth=DEPTH)}".replace(
        "FROM steps st JOIN", f"FROM (SELECT * FROM steps WHERE {which}) st JOIN")
    for name in ("tw", "nws", "crd", "placed", "tpairs", "intra", "cnt", "grid", "map"):
        text = text.replace(f"\n{name} AS (", f"\n{name}{suffix} AS (")
        alias = f" {name}" if name in ("tw", "nws") else ""
        for kw in ("FROM", "JOIN"):
            text = text.replace(f"{kw} {name} ", f"{kw} {name}{suffix}{alias} ").replace(f"{kw} {name})", f"{kw} {name}{suffix})")
    return text


SIM = f"WITH {GENOME}, {NODE_TILES}, {CUSTOMER_STEPS}, {placed_sql('ntiles')}, {map_sql('ntiles', depth=DEPTH)}, {CONTACTS}"
ALIGNED = f"""{SIM},
  al AS (SELECT m.i, m.j, m.widthprod, coalesce(c.value, 0) AS x, m.value AS mu FROM map m LEFT JOIN contacts c ON c.i = m.i AND c.j = m.j)"""
E0 = f"{AREA0!r}::DOUBLE"
NB2 = "(ln(x + 1) + 2 * ln(2 / (2 + mu)) + x * ln(mu / (2 + mu)))"
NB35 = "(lgamma(x + 3.5) - lgamma(3.5) - lgamma(x + 1) + 3.5 * ln(3.5 / (3.5 + mu)) + x * ln(mu / (3.5 + mu)))"
POIS = "(x * ln(mu) - mu - lgamma(x + 1))"
PAIR = f"""WITH {GENOME}, {NODE_TILES}, {CUSTOMER_STEPS}, {_map('circular', '_a')}, {_map('NOT circular', '_b')},
  pair AS (SELECT a.i, a.j, a.widthprod, a.value AS a, b.value AS b FROM map_a a JOIN map_b b ON a.i = b.i AND a.j = b.j)"""


def _noise(src: str, mean: str, seed: int, samples: int) -> str:
    g = [f"floor(ln({sql_uniform(seed + 7907 * r, 'm', 'i', 'j')}) / ln({mean} / ({mean} + 2.0::DOUBLE)))" for r in (1, 2)]
    return f"SELECT {src}.*, CAST(m AS INTEGER) AS map_id, CASE WHEN {mean} > 0 THEN {g[0]} + {g[1]} ELSE 0 END AS x FROM {src} CROSS JOIN range(1, {samples + 1}) s(m)"


def _ratios(samples: int) -> str:
    nb = lambda mu: NB2.replace("mu", mu)
    return f"""
noisy AS (SELECT 'a' AS source, * FROM ({_noise('pair', 'a', 9, samples)}) UNION ALL
          SELECT 'b', * FROM ({_noise('pair', 'b', 110, samples)})),
ratios AS (SELECT source, map_id, sum(widthprod / {E0} * ({nb('a')} - {nb('b')})) AS llr FROM noisy GROUP BY ALL)"""


TESTED = f"""{SIM},
  tested AS (SELECT m.i, m.j, m.value AS mu, coalesce(c.value, 0) AS x FROM map m LEFT JOIN contacts c ON c.i = m.i AND c.j = m.j)"""
TAIL = "CASE WHEN x <= 0 THEN 1.0::DOUBLE ELSE pow(mu / (2 + mu), x) * (1 + x * (2 / (2 + mu))) END"
# the same tail in the order of operations of a binomial sum
TAIL = ("CASE WHEN x <= 0 THEN 1.0::DOUBLE ELSE pow(mu / (2 + mu), x + 1) + (x + 1) * (2 / (2 + mu)) * pow(mu / (2 + mu), x) END")


def _bh(p: str) -> str:
    return f"""{TESTED},
  pv AS (SELECT *, {p} AS p FROM tested),
  rk AS (SELECT *, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS r, count(*) OVER () AS n FROM pv),
  fdr AS (SELECT *, least(1.0, min(p * n / r) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS fdr FROM rk)
  SELECT i, j, round(CASE WHEN x = 0 AND mu = 0 THEN 0 WHEN x = 0 THEN NULL ELSE ln(x / mu) END, 8) AS logoe,
         round(-ln(greatest(p, 5e-324)), 6) AS neglogp FROM fdr WHERE fdr < 0.05"""


QUERIES = {
    "nll_pixels": (nll_pixels, f"{ALIGNED} SELECT i, j, round(-widthprod / {E0} * {NB2}, 7) AS value FROM al"),
    "nll_scores": (nll_scores, f"""{ALIGNED}
        SELECT 'nb2' AS model, round(sum(-widthprod / {E0} * {NB2}), 1) AS value FROM al
        UNION ALL SELECT 'nb2_offdiag', round(sum(-widthprod / {E0} * {NB2}), 1) FROM al WHERE i <> j
        UNION ALL SELECT 'nb3.5', round(sum(-widthprod / {E0} * {NB35}), 1) FROM al
        UNION ALL SELECT 'poisson', round(sum(-widthprod / {E0} * {POIS}), 1) FROM al"""),
    "nll_masked": (nll_masked, f"""{ALIGNED},
        mk AS (SELECT node_id FROM genome WHERE node_id % 3 = 0),
        sc AS (SELECT CASE WHEN i IN (FROM mk) AND j IN (FROM mk) THEN 0 ELSE -widthprod / {E0} * {NB2} END AS v FROM al)
        SELECT v = 0 AS zero, count(*) AS pixels, round(sum(v), 2) AS value FROM sc GROUP BY 1"""),
    "kl_maps": (kl_maps, f"""{PAIR}
        SELECT i, j, round(widthprod / {E0} * greatest(0, greatest(a, 1e-10) * ln(greatest(a, 1e-10) / greatest(b, 1e-10))
               + (2 + greatest(a, 1e-10)) * ln((2 + greatest(b, 1e-10)) / (2 + greatest(a, 1e-10)))), 7) AS value FROM pair"""),
    "noisy_maps": (noisy_maps, f"{SIM}, noisy AS ({_noise('map', 'value', 5, 3)}) SELECT map_id, i, j, x AS value FROM noisy"),
    "noisy_poisson": (noisy_poisson, None),
    "separability": (separability, f"""{PAIR}, {_ratios(SAMPLES)}
        SELECT avg(CASE WHEN source = 'a' THEN (llr < 0)::INT ELSE (llr > 0)::INT END) AS error_rate FROM ratios"""),
    "f1_maps": (f1_maps, f"""{PAIR}, {_ratios(F1_SAMPLES)},
        c AS (SELECT quantile_cont(-llr, {1 - SIGNIFICANCE!r}) AS cutoff FROM ratios WHERE source = 'a'),
        h AS (SELECT cutoff, count(*) FILTER (-llr > cutoff) AS tp, count(*) FILTER (-llr <= cutoff) AS fn
              FROM ratios CROSS JOIN c WHERE source = 'b' GROUP BY cutoff)
        SELECT round(cutoff, 3) AS cutoff, tp, fn, round(2 * tp / (2 * tp + {SIGNIFICANCE * F1_SAMPLES!r}::DOUBLE + fn), 9) AS f1 FROM h"""),
    "loops": (loops, _bh(TAIL)),
    "loops_all": (loops_all, _bh(f"exp({NB2})")),
    "qq_data": (qq_data, f"""{TESTED}, pv AS (SELECT round({TAIL}, 12) AS p FROM tested)
        SELECT row_number() OVER (ORDER BY p) AS rank, p, round((row_number() OVER (ORDER BY p) - 0.5) / count(*) OVER (), 12) AS expected FROM pv"""),
    "depth_ratio": (depth_ratio, f"WITH {CONTACTS} SELECT round(sum(value) * 300 / 3e9 * 2 / 2, 9) AS depth FROM contacts"),
}

"""Registered queries of the calibration fit, on observed contacts over equal tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from walkweave.functions.rand import sql_draw
from walkweave.operators import training as TR
from walkweave.plans import tables as T
from walkweave.plans.oracle import CONTACTS
from walkweave.session import cut
from walkweave.sources.calibration import SYNTHETIC

WIDTH = 30_000
DEPTH = 2.0
SAMPLE = 400


def equal_tiles(spark, sf):
    k = F.col("node_id") - 1
    return T.genome(spark, sf).select(
        F.col("node_id").alias("tile_id"), "seqnames", (k % T.PER_CHROMOSOME * WIDTH + 1).cast("long").alias("start"),
        ((k % T.PER_CHROMOSOME + 1) * WIDTH).cast("long").alias("end"), F.lit(WIDTH).cast("long").alias("width"))


def _geometry(spark, sf):
    return TR.pixel_geometry(T.contacts(spark, sf), equal_tiles(spark, sf))


def pixel_geometry(spark, sf):
    return _geometry(spark, sf)


def distance_means(spark, sf):
    return TR.distance_means(_geometry(spark, sf)).withColumn("value", F.round("value", 6))


def haploid_depth(spark, sf):
    return TR.haploid_depth(T.contacts(spark, sf)).withColumn("depth", F.round("depth", 10))


def _diagonals(spark, sf, scales):
    """Diagonal pixels of the same map at several resolutions."""
    sums = None
    for scale in scales:
        idx = lambda c: (F.floor((F.col(c) - 1) / scale) + 1).cast("int").alias(c)  # noqa: E731, B023
        coarse = T.contacts(spark, sf).groupBy(idx("i"), idx("j")).agg(F.sum("value").alias("value")).filter("i = j")
        row = coarse.select(F.lit(0.0).alias("dist"), F.lit(float(WIDTH * scale) ** 2).alias("widthprod"), "value")
        sums = row if sums is None else sums.unionByName(row)
    return sums


def diagonal_fit(spark, sf):
    """Diagonal line over three resolutions of the same map."""
    fit = TR.diagonal_fit(_diagonals(spark, sf, (1, 2, 5)), DEPTH)
    return fit.select(F.round("intercept", 7).alias("intercept"), F.round("slope", 7).alias("slope"))


def interchrom_density(spark, sf):
    out = TR.interchrom_density(T.contacts(spark, sf), equal_tiles(spark, sf), DEPTH)
    return out.select(F.round(F.col("density") * 1e9, 9).alias("density_e9"))


def _noise_rows(spark, sf):
    means = SYNTHETIC.contact(F.col("widthprod"), F.col("dist")) * DEPTH
    return _geometry(spark, sf).withColumn("expected", means)


def density_tranches(spark, sf):
    out = TR.tranches(_noise_rows(spark, sf), 20)
    return out.select("tranche", "widthprod", F.round(F.col("mexp") * 1e9, 8).alias("mexp"), F.round("err", 7).alias("err"),
                      F.round(F.col("mdat") * 1e9, 8).alias("mdat"))


def restored_zeros(spark, sf):
    """Sampled pixels and restored zeros per distance class."""
    rows = TR.restore_zeros(cut(_geometry(spark, sf)), SAMPLE)
    return rows.groupBy("dist").agg(F.count(F.lit(1)).alias("pixels"), F.sum("value").alias("value"))


def fitted_decay(spark, sf):
    """Coefficients of the decay fitted to the whole map."""
    means = cut(TR.distance_means(_geometry(spark, sf)).unionByName(_diagonals(spark, sf, (2, 5))))
    decay = TR.fit_decay(means, DEPTH, float(WIDTH) ** 2, 1e-11)
    from walkweave.sources.sinks import decay_table

    return decay_table(spark, decay)


def dispersion(spark, sf):
    """Dispersion of the observed counts around their distance means."""
    geo = _geometry(spark, sf)
    rows = geo.join(TR.distance_means(geo).withColumnRenamed("value", "expected"), ["dist", "widthprod"])
    theta = TR.dispersion(cut(rows.select("value", "expected")))
    return rows.agg(F.count(F.lit(1)).alias("pixels")).withColumn("theta", F.round(F.lit(theta), 2))


GEO = f"""
tl AS (SELECT t + 1 AS tile_id, t // 10 AS chr, t % 10 * {WIDTH} + 1 AS s, (t % 10 + 1) * {WIDTH} AS e FROM range(120) r(t)),
alike AS (
  SELECT abs((a.s + a.e) / 2 - (b.s + b.e) / 2)::DOUBLE AS dist, count(*) AS num
  FROM tl a JOIN tl b ON a.chr = b.chr AND a.tile_id <= b.tile_id GROUP BY 1),
geo AS (
  SELECT c.i, c.j, c.value, {float(WIDTH) ** 2!r}::DOUBLE AS widthprod, alike.dist, num
  FROM contacts c JOIN tl a ON a.tile_id = c.i JOIN tl b ON b.tile_id = c.j AND a.chr = b.chr
  JOIN alike ON alike.dist = abs((a.s + a.e) / 2 - (b.s + b.e) / 2))"""

QUERIES = {
    "pixel_geometry": (pixel_geometry, f"WITH {CONTACTS}, {GEO} SELECT * FROM geo"),
    "distance_means": (distance_means, f"""WITH {CONTACTS}, {GEO}
        SELECT dist, widthprod, round(sum(value) / any_value(num), 6) AS value FROM geo GROUP BY ALL"""),
    "haploid_depth": (haploid_depth, f"WITH {CONTACTS} SELECT round(sum(value) * 300 / 6e9, 10) AS depth FROM contacts"),
    "diagonal_fit": (diagonal_fit, f"""WITH {CONTACTS},
        d AS (SELECT r, (i - 1) // r AS k, sum(value) AS value FROM contacts CROSS JOIN (VALUES (1), (2), (5)) v(r)
              WHERE (i - 1) // r = (j - 1) // r GROUP BY ALL),
        p AS (SELECT ln(value / {2 * DEPTH!r}) AS y, ln(({WIDTH} * r)::DOUBLE * ({WIDTH} * r)) AS x FROM d)
        SELECT round(regr_intercept(y, x), 7) AS intercept, round(regr_slope(y, x), 7) AS slope FROM p"""),
    "interchrom_density": (interchrom_density, f"""WITH {CONTACTS}
        SELECT round(sum(value) FILTER ((i - 1) // 10 <> (j - 1) // 10) / (66 * ({10 * WIDTH})::DOUBLE * {10 * WIDTH} * {DEPTH!r}::DOUBLE * 4) * 1e9, 9) AS density_e9
        FROM contacts"""),
    "density_tranches": (density_tranches, f"""WITH {CONTACTS}, {GEO},
        n AS (SELECT widthprod, value / widthprod AS d, ({SYNTHETIC.sql_contact('widthprod', 'dist')}) * {DEPTH!r}::DOUBLE / widthprod AS p FROM geo),
        m AS (SELECT min(ln(p)) AS lo, max(ln(p)) AS hi FROM n),
        b AS (SELECT *, CAST(least(floor((ln(p) - lo) / (hi - lo) * 20) + 1, 20) AS INTEGER) AS tranche FROM n CROSS JOIN m)
        SELECT tranche, widthprod, round(avg(p) * 1e9, 8) AS mexp, round(stddev_samp(d) / avg(p), 7) AS err, round(avg(d) * 1e9, 8) AS mdat
        FROM b GROUP BY tranche, widthprod"""),
    "restored_zeros": (restored_zeros, f"""WITH {CONTACTS}, {GEO},
        kept AS (SELECT dist, widthprod, any_value(num) - count(*) AS zeros FROM geo GROUP BY ALL),
        drawn AS (SELECT * FROM geo ORDER BY {sql_draw(1, 'i', 'j')}, i, j LIMIT {SAMPLE}),
        share AS (SELECT least(1.0::DOUBLE, {SAMPLE}::DOUBLE / count(*)) AS f FROM geo),
        back AS (
          SELECT dist, unnest(range(CAST(floor(zeros * f) AS BIGINT))) AS k
          FROM (SELECT DISTINCT dist, widthprod FROM drawn) JOIN kept USING (dist, widthprod) CROSS JOIN share WHERE floor(zeros * f) > 0)
        SELECT dist, count(*) AS pixels, sum(value) AS value
        FROM (SELECT dist, value::DOUBLE AS value FROM drawn UNION ALL SELECT dist, 0.0 FROM back) GROUP BY dist"""),
    "fitted_decay": (fitted_decay, None),
    "dispersion": (dispersion, None),
}

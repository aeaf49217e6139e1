"""Fitting the decay calibration and the dispersion from an observed map."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkweave.functions.rand import draw
from walkweave.functions.stats import lgamma
from walkweave.sources.calibration import Decay, cubic_spline

# Base pairs per contact and haploid genome pairs of the depth estimate.
BASES_PER_CONTACT = 300
GENOME_BASES = 6e9


def _geometry(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    at = lambda c: tiles.select(
        F.col("tile_id").alias(c), F.col("seqnames").alias(f"s{c}"), F.col("width").cast("double").alias(f"w{c}"),
        ((F.col("start") + F.col("end")) / 2).alias(f"m{c}"))
    return pixels.join(at("i"), "i").join(at("j"), "j").withColumns(
        {"widthprod": F.col("wi") * F.col("wj"), "dist": F.abs(F.col("mi") - F.col("mj"))})


def pixel_geometry(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pixels of one chromosome arm set with area, distance and the number of possible pixels alike.

    ``(i, j, value, widthprod, dist, num)``; only pixels within a chromosome have a distance.
    """
    at = lambda k: tiles.select("seqnames", F.col("tile_id").alias(f"t{k}"), F.col("width").cast("double").alias(f"w{k}"),
                                ((F.col("start") + F.col("end")) / 2).alias(f"m{k}"))
    alike = at(1).join(at(2), "seqnames").filter("t1 <= t2").select(
        (F.col("w1") * F.col("w2")).alias("widthprod"), F.abs(F.col("m1") - F.col("m2")).alias("dist"))
    num = alike.groupBy("dist", "widthprod").agg(F.count(F.lit(1)).alias("num"))
    seen = _geometry(pixels, tiles).filter("si = sj")
    return seen.join(num, ["dist", "widthprod"]).select("i", "j", "value", "widthprod", "dist", "num")


def distance_means(geometry: DataFrame) -> DataFrame:
    """Mean contacts per possible pixel: ``(dist, widthprod, value)``."""
    return geometry.groupBy("dist", "widthprod").agg((F.sum("value") / F.first("num")).alias("value"))


def haploid_depth(pixels: DataFrame) -> DataFrame:
    return pixels.agg((F.sum("value") * BASES_PER_CONTACT / GENOME_BASES).alias("depth"))


def diagonal_fit(means: DataFrame, depth: float) -> DataFrame:
    """Least squares of ln(contacts / 2 depth) on ln(area) over the diagonal: ``(intercept, slope)``."""
    y, x = F.ln(F.col("value") / (2 * depth)), F.ln("widthprod")
    return means.filter("dist = 0").agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))


def interchrom_density(pixels: DataFrame, tiles: DataFrame, depth: float) -> DataFrame:
    """Contacts between chromosomes per area, copy pair and depth: ``(density)``."""
    between = _geometry(pixels, tiles).filter("si <> sj").agg(F.sum("value").alias("hits"))
    sizes = tiles.groupBy("seqnames").agg(F.sum("width").cast("double").alias("w"))
    # sum over pairs of chromosomes = (total^2 - sum of squares) / 2
    area = sizes.agg(((F.sum("w") * F.sum("w") - F.sum(F.col("w") * F.col("w"))) / 2).alias("area"))
    hits = float(between.first()[0] or 0.0)
    return area.select((F.lit(hits) / (F.col("area") * depth * 4)).alias("density"))


def fit_decay(means: DataFrame, depth: float, area: float, interchrom: float) -> Decay:
    """Spline through the mean densities at one area plus the diagonal line.

    One knot per tile distance: the number of knots is the tile count of a chromosome.
    """
    knots = means.filter((F.col("dist") > 0) & (F.col("widthprod") == area) & (F.col("value") > 0)).select(
        F.ln("dist").alias("x"), F.ln(F.col("value") / (2 * depth * area)).alias("y")).orderBy("x").collect()
    line = diagonal_fit(means, depth).first()
    if line["slope"] is None:
        raise ValueError("the diagonal needs tiles of at least two sizes")
    fitted = cubic_spline([k["x"] for k in knots], [k["y"] for k in knots])
    return replace(fitted, diagonal=(line["intercept"], line["slope"]), interchrom=interchrom)


def predict(decay: Decay, dist: Column, area: Column, depth: float = 1) -> Column:
    return decay.contact(area, dist) * depth


def restore_zeros(geometry: DataFrame, sample: int, seed: int = 1) -> DataFrame:
    """A random sample of pixels with the missing zeros put back in proportion: ``(value, dist, widthprod)``.

    The sample size is the feature here.  Each sampled (dist, area) class gets
    ``floor(zeros * sample / pixels)`` zero rows.
    """
    total = geometry.count()
    kept = geometry.groupBy("dist", "widthprod").agg((F.first("num") - F.count(F.lit(1))).alias("_zeros"))
    drawn = geometry.withColumn("_o", draw(seed, F.col("i"), F.col("j"))).orderBy("_o", "i", "j").limit(sample)
    classes = drawn.select("dist", "widthprod").distinct().join(kept, ["dist", "widthprod"]).withColumn(
        "_k", F.floor(F.col("_zeros") * min(1.0, sample / total)))
    zeros = classes.filter("_k > 0").withColumn("_x", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k")))).select(
        F.lit(0.0).alias("value"), "dist", "widthprod")
    return drawn.select(F.col("value").cast("double").alias("value"), "dist", "widthprod").unionByName(zeros)


def dispersion(rows: DataFrame, low: float = 0.05, high: float = 50.0, passes: int = 4, grid: int = 17) -> float:
    """Maximum-likelihood NB size for counts ``value`` with means ``expected``.

    Every pass evaluates the likelihood for a grid of sizes in one aggregation and narrows the range.
    """
    x, mu = F.bround(F.col("value")), F.col("expected")
    for _ in range(passes):
        ratio = (high / low) ** (1 / (grid - 1))
        sizes = [low * ratio**k for k in range(grid)]
        t = F.col("_t")
        term = F.when(mu > 0, lgamma(x + t) - lgamma(t) - lgamma(x + 1.0) + t * F.ln(t / (t + mu)) + x * F.ln(mu / (t + mu))).otherwise(0.0)
        tried = rows.withColumn("_t", F.explode(F.array(*[F.lit(s) for s in sizes])))
        sums = {r["_t"]: r["s"] for r in tried.groupBy("_t").agg(F.sum(term).alias("s")).collect()}
        best = max(range(grid), key=lambda k: sums[sizes[k]])
        low, high = sizes[max(0, best - 1)], sizes[min(grid - 1, best + 1)]
    return (low * high) ** 0.5


def tranches(rows: DataFrame, breaks: int = 100) -> DataFrame:
    """Mean expected density, relative spread and mean density by tranche of ln(expected density) and area.

    ``rows`` has ``value, expected, widthprod``.
    """
    dens = rows.select("widthprod", (F.col("value") / F.col("widthprod")).alias("d"), (F.col("expected") / F.col("widthprod")).alias("p"))
    ends = dens.agg(F.min(F.ln("p")).alias("lo"), F.max(F.ln("p")).alias("hi")).first()
    cut = F.least(F.width_bucket(F.ln("p"), F.lit(ends["lo"]), F.lit(ends["hi"]), F.lit(breaks)), F.lit(breaks))
    return dens.groupBy(cut.cast("int").alias("tranche"), "widthprod").agg(
        F.avg("p").alias("mexp"), (F.stddev_samp("d") / F.avg("p")).alias("err"), F.avg("d").alias("mdat"))



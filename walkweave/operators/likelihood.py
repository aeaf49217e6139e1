"""Comparing contact maps: likelihoods, divergences, noise, separability, loop calls, FDR.

Maps are ``(i, j, widthprod, value)`` over one tiling; extra key columns (``by``) hold many maps at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkweave.functions.rand import nb_draw, uniform
from walkweave.functions.stats import count_logpmf, nb_kl, nb_upper_tail
from walkweave.operators.skew import number_rows

DEFAULT_AREA = 1e8


def median_area(tiles: DataFrame) -> float:
    """Square of the median tile width (one number, taken once per tiling)."""
    return float(tiles.agg(F.median("width")).first()[0]) ** 2


def align(observed: DataFrame, expected: DataFrame, grid: DataFrame) -> DataFrame:
    """Both maps over the whole grid, missing pixels zero: ``(i, j, widthprod, x, mu)``."""
    one = lambda df, c: df.select("i", "j", F.col("value").alias(c))
    zero = F.lit(0.0)
    return (
        grid.select("i", "j", "widthprod").join(one(observed, "x"), ["i", "j"], "left").join(one(expected, "mu"), ["i", "j"], "left")
        .withColumns({"x": F.coalesce("x", zero), "mu": F.coalesce("mu", zero)})
    )


def pixel_score(x: Column, mu: Column, area: Column, theta: float = 2, area0: float = DEFAULT_AREA, kl: bool = False) -> Column:
    """Area-weighted negative log likelihood of ``x`` under mean ``mu``, or NB divergence of the means."""
    if kl:
        return area / area0 * F.when(mu == 0, 0.0).otherwise(nb_kl(x, mu, theta)) if theta > 0 else F.lit(None)
    return -(area / area0) * count_logpmf(x, mu, theta)


def compare_pixels(aligned: DataFrame, theta: float = 2, diagonal: bool = True, kl: bool = False,
                   area0: float = DEFAULT_AREA, masked: DataFrame | None = None, mask_mode: str = "both") -> DataFrame:
    """Score per pixel ``(i, j, value)``.

    ``masked`` lists tile ids; a pixel scores zero when both its tiles are masked (``mask_mode='any'``: either).
    """
    rows = aligned if diagonal else aligned.filter("i <> j")
    area = F.col("widthprod") if "widthprod" in aligned.columns else F.lit(area0)
    scored = rows.withColumn("value", pixel_score(F.col("x"), F.col("mu"), area, theta, area0, kl))
    if masked is not None:
        at = lambda c: masked.select(F.col("tile_id").alias(c), F.lit(True).alias(f"_m{c}")).distinct()
        scored = scored.join(at("i"), "i", "left").join(at("j"), "j", "left")
        mi, mj = F.coalesce("_mi", F.lit(False)), F.coalesce("_mj", F.lit(False))
        scored = scored.withColumn("value", F.when((mi & mj) if mask_mode == "both" else (mi | mj), 0.0).otherwise(F.col("value")))
    return scored.select("i", "j", "value")


def total_score(scored: DataFrame) -> DataFrame:
    return scored.agg(F.sum("value").alias("value"))


def _counts(batches: Iterator[pd.DataFrame], theta: float) -> Iterator[pd.DataFrame]:
    """Inverse-CDF draws: all rows of a batch step through the counts together."""
    for pdf in batches:
        u, mu = pdf["_u"].to_numpy(float), pdf["_mu"].to_numpy(float)
        k = np.zeros(len(u))
        with np.errstate(divide="ignore", invalid="ignore"):
            if theta > 0:
                q = mu / (mu + theta)
                p = np.exp(theta * np.log1p(-q))
            else:
                p = np.exp(-mu)
            cdf = p.copy()
            todo = np.flatnonzero((mu > 0) & (u > cdf))
            while len(todo):
                k[todo] += 1
                p[todo] *= (q[todo] * (k[todo] + theta - 1) if theta > 0 else mu[todo]) / k[todo]
                cdf[todo] += p[todo]
                todo = todo[(u[todo] > cdf[todo]) & (p[todo] > 0)]
        yield pdf.assign(value=k).drop(columns=["_u", "_mu"])


#: a Poisson or non-integer NB mean above this is drawn as a sum of equal parts (exact: both are infinitely divisible)
PART_MEAN = 200.0


def noisy_maps(pixels: DataFrame, samples: int, theta: float = 2, seed: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """``samples`` random count maps with the given means: adds ``map_id``, replaces ``value``.

    NB counts for theta > 0, Poisson for theta = 0.  Every draw depends on (seed, map, pixel) only.
    """
    many = pixels.withColumn("map_id", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    keys = (F.col("map_id"), F.col("i"), F.col("j"))
    if theta > 0 and float(theta).is_integer():
        return many.withColumn("value", nb_draw(F.col("value"), int(theta), seed, *keys))
    # parts keep exp(-mean) and the step count small; an NB of size r is a sum of NBs of size r / parts
    if theta > 0:
        drawn = many.withColumns({"_u": uniform(seed, *keys), "_mu": F.col("value").cast("double")}).drop("value")
        schema = drawn.drop("_u", "_mu").schema.add("value", "double")
        return drawn.mapInPandas(lambda it: _counts(it, theta), schema)
    parts = F.greatest(F.ceil(F.col("value") / PART_MEAN), F.lit(1))
    split = many.withColumn("_parts", parts).withColumn("_part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_parts"))))
    split = split.withColumns({
        "_u": uniform(seed, *keys, F.col("_part")), "_mu": (F.col("value") / F.col("_parts")).cast("double")})
    rest = [c for c in many.columns if c != "value"]
    schema = split.select(*rest).schema.add("value", "double")
    drawn = split.select(*rest, "_u", "_mu").mapInPandas(lambda it: _counts(it, 0.0), schema)
    return drawn.groupBy(*rest).agg(F.sum("value").alias("value"))


def log_ratio(x: Column, mu_a: Column, mu_b: Column, area: Column, theta: float, area0: float = DEFAULT_AREA) -> Column:
    """Area-weighted log likelihood ratio of model a over model b."""
    return area / area0 * (count_logpmf(x, mu_a, theta) - count_logpmf(x, mu_b, theta))


def sample_ratios(pair: DataFrame, samples: int, theta: float = 2, seed: int = 1, area0: float = DEFAULT_AREA) -> DataFrame:
    """Log likelihood ratios of noisy samples of both maps: ``(source, map_id, llr)``.

    ``pair`` is ``(i, j, widthprod, a, b)``.
    """
    area = F.col("widthprod") if "widthprod" in pair.columns else F.lit(area0)
    out = None
    for k, source in enumerate("ab"):
        noisy = noisy_maps(pair.withColumn("value", F.col(source)), samples, theta, seed + k * 101)
        llr = noisy.groupBy(F.lit(source).alias("source"), "map_id").agg(
            F.sum(log_ratio(F.col("value"), F.col("a"), F.col("b"), area, theta, area0)).alias("llr"))
        out = llr if out is None else out.unionByName(llr)
    return out


def separability_error(ratios: DataFrame, strict: bool = True) -> DataFrame:
    """Share of samples that the ratio assigns to the wrong map (ties count as wrong when not strict)."""
    a = F.col("llr") < 0 if strict else F.col("llr") <= 0
    b = F.col("llr") > 0 if strict else F.col("llr") >= 0
    wrong = F.when(F.col("source") == "a", a).otherwise(b)
    return ratios.agg(F.avg(wrong.cast("double")).alias("error_rate"))


def f1_score(ratios: DataFrame, significance: float, samples: int) -> DataFrame:
    """F1 of a likelihood-ratio test of the null map ``a`` against ``b``.

    The cutoff is the (1 - significance) quantile of the null's ratios in favour of ``b``.
    """
    favour = ratios.select("source", (-F.col("llr")).alias("r"))
    cut = favour.filter("source = 'a'").agg(F.percentile("r", F.lit(1 - significance)).alias("cutoff"))
    hyp = favour.filter("source = 'b'").groupBy("source").agg(F.collect_list("r").alias("r"))
    tp = F.size(F.filter("r", lambda v: v > F.col("cutoff")))
    fn = F.size("r") - tp
    both = cut.withColumn("source", F.lit("b")).join(hyp, "source")
    return both.select("cutoff", tp.alias("tp"), fn.alias("fn"), (2 * tp / (2 * tp + significance * samples + fn)).alias("f1"))


def _p_bucket(p: Column) -> Column:
    """Order-preserving bucket of a probability: linear steps, finer near zero."""
    return F.struct(F.floor(p * 4096).alias("a"), F.floor(F.ln(F.greatest(p, F.lit(1e-300))) * 16).alias("b"))


def benjamini_hochberg(df: DataFrame, p: str = "p", out: str = "fdr") -> DataFrame:
    """Step-up FDR of every row."""
    return df.join(fdr_levels(df, p, out), p, "left")


def fdr_levels(df: DataFrame, p: str = "p", out: str = "fdr") -> DataFrame:
    """Step-up FDR of every distinct p-value, from their counts, in two phases over p-buckets."""
    counts = df.filter(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", _p_bucket(F.col(p)))
    buckets = counts.groupBy("_b").agg(F.sum("_c").alias("_t"))
    w = Window.orderBy("_b")
    buckets = buckets.select(
        "_b", F.coalesce(F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_t").over(Window.partitionBy()).alias("_n"))
    inner = Window.partitionBy("_b").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(buckets, "_b").withColumn(
        "_v", F.col(p) * F.col("_n") / (F.col("_off") + F.sum("_c").over(inner)))
    low = ranked.groupBy("_b").agg(F.min("_v").alias("_m"))
    later = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    low = low.select("_b", F.min("_m").over(later).alias("_later"))
    inside = Window.partitionBy("_b").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.join(low, "_b").select(
        p, F.least(F.min("_v").over(inside), F.coalesce("_later", F.lit(1.0)), F.lit(1.0)).alias(out))


def loop_pvalues(expected: DataFrame, measured: DataFrame, theta: int = 2, mode: str = "peaks") -> DataFrame:
    """``(i, j, measured, expected, p)``: upper tail (``peaks``) or point probability (``all``)."""
    if mode not in ("peaks", "all"):
        raise ValueError(f"unknown mode {mode!r}")
    both = expected.select("i", "j", F.col("value").alias("expected")).join(
        measured.select("i", "j", F.col("value").alias("measured")), ["i", "j"], "left"
    ).withColumn("measured", F.coalesce("measured", F.lit(0.0)))
    m, mu = F.col("measured"), F.col("expected")
    if mode == "peaks":
        return both.withColumn("p", nb_upper_tail(m, mu, theta))
    exact = F.exp(count_logpmf(m, mu, theta))
    return both.withColumn("p", F.when((mu == 0) & (m > 0), 0.0).otherwise(exact))


def call_loops(expected: DataFrame, measured: DataFrame, fdr_cut: float = 0.01, theta: int = 2, mode: str = "peaks") -> DataFrame:
    """Significant pixels ``(i, j, logoe, neglogp)``."""
    tested = loop_pvalues(expected, measured, theta, mode)
    # Only significant p-values are joined: the many pixels of p = 1 meet none.
    tested = tested.join(fdr_levels(tested).filter(F.col("fdr") < fdr_cut), "p")
    m, mu = F.col("measured"), F.col("expected")
    return tested.select(
        "i", "j", F.when((m == 0) & (mu == 0), 0.0).otherwise(F.ln(m / mu)).alias("logoe"),
        (-F.ln(F.greatest("p", F.lit(5e-324)))).alias("neglogp"))


def qq_points(df: DataFrame, p: str = "p") -> DataFrame:
    """Sorted p-values against uniform quantiles: ``(rank, p, expected)``."""
    keyed = df.select(F.lit(0).alias("_k"), p)
    ranked = number_rows(keyed, "_k", _p_bucket(F.col(p)), [F.col(p)], hot=None, pos="rank", total="_n")
    return ranked.select("rank", p, ((F.col("rank") - 0.5) / F.col("_n")).alias("expected"))


def depth_ratio(pixels: DataFrame, ploidy: int = 2) -> DataFrame:
    # 300 bp per contact, 3e9 bp genome.
    return pixels.agg((F.sum("value") * 300 / 3e9 * 2 / ploidy).alias("depth"))

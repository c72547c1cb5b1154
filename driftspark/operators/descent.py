"""Ballistic constants b of descents: robust fit, one-point form, shrinkage towards a prior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftspark.operators.kinematics import KEY
from driftspark.params import DEFAULTS, Params


def _clamp(b, p: Params):
    return F.least(F.greatest(b, F.lit(p.b_min)), F.lit(p.b_max))


def descent_samples(rates: DataFrame, bursts: DataFrame, key=KEY) -> DataFrame:
    """(flight, t, alt, v_obs, rho): falling frames after the burst; rho needs a density column."""
    return rates.join(bursts, list(key)).where((F.col("t") >= F.col("burst_t")) & (F.col("vrate") < 0)).select(*key, "t", "alt", (-F.col("vrate")).alias("v_obs"), "rho")


def fit_descent(samples: DataFrame, bursts: DataFrame, p: Params = DEFAULTS, key=KEY) -> DataFrame:
    """samples (flight, t, alt, v_obs, rho), bursts (flight, burst_t, burst_alt) to (flight, b, residual, n_points, clamped).

    The first seconds and metres after the burst go, then a change of regime keeps only what came after it, then outliers by
    the median deviation go; the rest is averaged with weights that halve with age. Flights with too few points are left out.
    """
    every = W.partitionBy(*key)
    k = max(p.min_fit_points, p.regime_points)
    s = samples.join(bursts, list(key), "left")
    t0 = F.coalesce("burst_t", F.min("t").over(every))
    top = F.coalesce("burst_alt", F.max("alt").over(every))
    s = s.withColumn("age0", F.col("t") - t0).withColumn("fallen", top - F.col("alt"))
    s = s.where((F.col("age0") >= p.transient_s) & (F.col("fallen") >= p.transient_m))
    s = s.withColumn("n0", F.count("*").over(every)).where((F.col("n0") >= p.min_fit_points) & (F.col("rho") > 0) & (F.col("v_obs") > 0))
    s = s.withColumn("bi", F.col("v_obs") * F.sqrt("rho")).withColumn("n", F.count("*").over(every)).where(F.col("n") >= p.min_fit_points)
    s = s.withColumn("back", F.row_number().over(every.orderBy(F.desc("t"))))  # 1 is the newest
    recent = F.percentile(F.when(F.col("back") <= k, F.col("bi")), 0.5).over(every)
    older = F.percentile(F.when(F.col("back") > k, F.col("bi")), 0.5).over(every)
    s = s.withColumn("recent", recent).withColumn("older", older)
    changed = (F.col("n") >= 2 * k) & (F.col("older") > 0) & (F.abs(F.col("recent") - F.col("older")) / F.col("older") > p.regime_rel)
    # walking back from the newest: how many in a row lie near the recent median
    off = (F.abs(F.col("bi") - F.col("recent")) / F.col("recent") > p.regime_rel / 2) & (F.col("back") > 1)
    s = s.withColumn("stops", F.sum(off.cast("int")).over(every.orderBy("back")))
    s = s.where(F.coalesce(~changed, F.lit(True)) | (F.col("stops") == 0) | (F.col("back") <= k))
    s = s.withColumn("dev", F.abs(F.col("bi") - F.percentile("bi", 0.5).over(every)))
    mad = F.percentile("dev", 0.5).over(every)
    s = s.withColumn("mad", F.when(mad == 0, F.lit(1e-9)).otherwise(mad)).where(F.col("dev") <= 3.5 * 1.4826 * F.col("mad"))
    s = s.withColumn("w", F.pow(F.lit(0.5), (F.max("t").over(every) - F.col("t")) / p.half_life_s))
    raw = F.sum(F.col("w") * F.col("bi")).over(every) / F.sum("w").over(every)
    s = s.withColumn("raw", raw).withColumn("b", _clamp(F.col("raw"), p)).withColumn("off", F.col("v_obs") - F.col("b") * F.pow("rho", F.lit(-0.5)))
    out = s.groupBy(*key, "b", "raw").agg(F.sqrt(F.sum(F.col("w") * F.col("off") * F.col("off")) / F.sum("w")).alias("residual"), F.count("*").alias("n_points"))
    return out.where(F.col("n_points") >= p.min_fit_points).select(*key, "b", "residual", "n_points", (F.col("raw") != F.col("b")).alias("clamped"))


def shortcut_descent(samples: DataFrame, p: Params = DEFAULTS, key=KEY) -> DataFrame:
    """(flight, b, clamped) of the last sample alone."""
    raw = F.col("s.v_obs") * F.sqrt("s.rho")
    last = samples.groupBy(*key).agg(F.max_by(F.struct("v_obs", "rho"), "t").alias("s"))
    return last.select(*key, _clamp(raw, p).alias("b"), (raw != _clamp(raw, p)).alias("clamped"))


def shrink_b(fits: DataFrame, prior: DataFrame, on: list[str], p: Params = DEFAULTS) -> DataFrame:
    """fits (…, b, n_points) drawn towards prior (…, prior_b) with the weight of ``prior_strength`` points; adds b_shrunk."""
    joined = fits.join(prior, on, "left")
    mixed = (p.prior_strength * F.col("prior_b") + F.col("n_points") * F.col("b")) / (p.prior_strength + F.col("n_points"))
    return joined.withColumn("b_shrunk", _clamp(F.coalesce(mixed, F.col("b")), p))

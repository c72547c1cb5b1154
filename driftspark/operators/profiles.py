"""Wind and density by altitude bins, and values at given altitudes from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftspark.functions import scalars as S
from driftspark.operators.kinematics import KEY, plausible, segments
from driftspark.params import DEFAULTS, Params


def wind_profile(frames: DataFrame, p: Params = DEFAULTS, key=KEY) -> DataFrame:
    """(flight, bin_idx, alt, u, v, rho, n, lat, lon, t): means of the plausible segments' samples in each bin."""
    s = segments(frames, key).where(plausible(p))
    s = s.withColumn("bin_idx", F.floor(F.col("seg.alt_mid") / p.bin_m)).withColumn("rho", S.measured_density(F.col("pressure"), F.col("temp")))
    # longitudes around the antimeridian: the mean angle as a vector
    rad = F.radians("seg.lon_mid")
    out = s.groupBy(*key, "bin_idx").agg(
        F.avg("seg.u").alias("u"), F.avg("seg.v").alias("v"), F.avg("rho").alias("rho"), F.count("*").alias("n"),
        F.avg("seg.lat_mid").alias("lat"), F.avg("seg.lon_mid").alias("lon_plain"), F.max("seg.lon_mid").alias("lon_max"), F.min("seg.lon_mid").alias("lon_min"),
        F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))).alias("lon_angle"), F.avg("seg.t_mid").alias("t"),
    )
    lon = F.when(F.col("lon_max") - F.col("lon_min") > 180.0, F.col("lon_angle")).otherwise(F.col("lon_plain"))
    return out.select(*key, "bin_idx", ((F.col("bin_idx") + 0.5) * p.bin_m).alias("alt"), "u", "v", "rho", "n", "lat", lon.alias("lon"), "t")


def refreshed_profile(samples: DataFrame, p: Params = DEFAULTS, key=KEY) -> DataFrame:
    """As ``wind_profile`` of samples (flight, bin_idx, t, u, v, rho, descending), where a bin's past counts as at most
    ``refresh_cap`` samples once the flight descends: an ordered fold of each bin's few samples."""
    one = F.struct("t", "u", "v", "rho", "descending")
    first = F.struct(F.lit(0.0).alias("u"), F.lit(0.0).alias("v"), F.lit(None).cast("double").alias("rho"), F.lit(0).cast("long").alias("n"))

    def add(b, x):
        n = F.when(x["descending"], F.least(b["n"], F.lit(p.refresh_cap).cast("long"))).otherwise(b["n"])
        mean = lambda old, new: (old * n + new) / (n + 1)
        rho = F.when(x["rho"].isNull(), b["rho"]).when(b["rho"].isNull(), x["rho"]).otherwise(mean(b["rho"], x["rho"]))
        return F.struct(mean(b["u"], x["u"]).alias("u"), mean(b["v"], x["v"]).alias("v"), rho.alias("rho"), (b["n"] + 1).alias("n"))

    out = samples.groupBy(*key, "bin_idx").agg(F.aggregate(F.sort_array(F.collect_list(one)), first, add).alias("b"))
    return out.select(*key, "bin_idx", ((F.col("bin_idx") + 0.5) * p.bin_m).alias("alt"), "b.*")


def column_cover(bins: DataFrame, alt_from: Column, alt_to: Column, p: Params = DEFAULTS, key=KEY) -> DataFrame:
    """(flight, lo, hi, n_bins, cover): the sampled range [lo, hi) and what part of [alt_to, alt_from] it covers."""
    r = bins.groupBy(*key).agg((F.min("bin_idx") * p.bin_m).alias("lo"), ((F.max("bin_idx") + 1) * p.bin_m).alias("hi"), F.count("*").alias("n_bins"))
    part = (F.least(alt_from, F.col("hi")) - F.greatest(alt_to, F.col("lo"))) / (alt_from - alt_to)
    return r.withColumn("cover", F.when(alt_from > alt_to, F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))).otherwise(F.lit(0.0)))


def residual_stats(pairs: DataFrame, key=KEY, least: int = 8, default_len: float = 1500.0) -> DataFrame:
    """(flight, alt, u, v, mu, mv) of measured and model winds to bias, scatter and vertical correlation length of the
    difference; flights of fewer than ``least`` bins are left out."""
    d = pairs.where("mu is not null and mv is not null").select(*key, "alt", (F.col("u") - F.col("mu")).alias("du"), (F.col("v") - F.col("mv")).alias("dv"))
    every, order = W.partitionBy(*key), W.partitionBy(*key).orderBy("alt")
    d = d.withColumn("ru", F.col("du") - F.avg("du").over(every)).withColumn("rv", F.col("dv") - F.avg("dv").over(every))
    d = d.withColumn("nu", F.lead("ru").over(order)).withColumn("nv", F.lead("rv").over(order)).withColumn("step", F.lead("alt").over(order) - F.col("alt"))
    g = d.groupBy(*key).agg(
        F.count("*").alias("n_bins"), F.avg("du").alias("bias_u"), F.avg("dv").alias("bias_v"),
        F.sqrt(F.sum(F.col("ru") * F.col("ru") + F.col("rv") * F.col("rv")) / (2 * F.count("*"))).alias("sigma"),
        F.sum(F.col("ru") * F.col("nu") + F.col("rv") * F.col("nv")).alias("num"),
        F.sum(F.when(F.col("nu").isNotNull(), F.col("ru") * F.col("ru") + F.col("rv") * F.col("rv"))).alias("den"),
        S.upper_median(F.col("step")).alias("step"),
    )
    lag1 = F.try_divide("num", "den")
    fits = (F.col("n_bins") >= 3) & (F.col("sigma") > 1e-6) & (F.col("den") > 0) & (lag1 > 0.05) & (lag1 < 0.995) & (F.col("step") > 0)
    length = F.when(fits, F.least(F.lit(6000.0), F.greatest(F.lit(200.0), -F.col("step") / F.log(lag1)))).otherwise(F.lit(default_len))
    pc = F.sqrt((F.col("bias_u") * F.col("bias_u") + F.col("bias_v") * F.col("bias_v")) / 2)
    return g.where(F.col("n_bins") >= least).select(*key, "n_bins", "sigma", "bias_u", "bias_v", pc.alias("bias_pc"), length.alias("corr_len"))


def _around(points: DataFrame, bins: DataFrame, columns, key, keep=None) -> DataFrame:
    """points (flight, alt, …) with lo and hi, the bins at or below and above each: the two are united and the last bin is
    carried up and the next one down, so nothing is joined on a range."""
    b = bins if keep is None else bins.where(keep)
    b = b.select(*key, F.col("alt"), F.struct("alt", *columns).alias("bin"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("point"))
    q = points.select(*key, "alt", F.lit(None).cast(b.schema["bin"].dataType).alias("bin"), F.struct("*").alias("point"))
    w = W.partitionBy(*key).orderBy("alt", F.col("bin").isNull())
    both = q.unionByName(b).withColumn("bin_lo", F.last("bin", True).over(w)).withColumn("bin_hi", F.first("bin", True).over(w.rowsBetween(1, W.unboundedFollowing)))
    return both.where("point is not null").select("point.*", "bin_lo", "bin_hi")


def bin_near(points: DataFrame, bins: DataFrame, key=KEY) -> DataFrame:
    """Adds near: the bin closest in altitude, the lower of two."""
    out = _around(points, bins, ["bin_idx", "u", "v", "lat", "lon", "t"], key)
    lower = F.col("bin_hi").isNull() | (F.col("alt") - F.col("bin_lo.alt") <= F.col("bin_hi.alt") - F.col("alt"))
    return out.withColumn("near", F.when(F.col("bin_lo").isNotNull() & lower, F.col("bin_lo")).otherwise(F.col("bin_hi"))).drop("bin_lo", "bin_hi")


def wind_at(points: DataFrame, bins: DataFrame, p: Params = DEFAULTS, key=KEY) -> DataFrame:
    """Adds u, v at alt: between bins linear, outside the column its edge, no column (0, 0). hole tells gaps and outsides,
    where callers that have a model take that instead."""
    out = _around(points, bins, ["bin_idx", "u", "v"], key)
    w = (F.col("alt") - F.col("bin_lo.alt")) / (F.col("bin_hi.alt") - F.col("bin_lo.alt"))
    mix = lambda c: F.when(F.col("bin_lo").isNull(), F.col(f"bin_hi.{c}")).when(F.col("bin_hi").isNull(), F.col(f"bin_lo.{c}")).otherwise(F.col(f"bin_lo.{c}") + w * (F.col(f"bin_hi.{c}") - F.col(f"bin_lo.{c}")))
    idx = F.floor(F.col("alt") / p.bin_m)
    outside = F.coalesce(F.col("bin_lo").isNull() & (idx < F.col("bin_hi.bin_idx")), F.lit(False)) | F.coalesce(F.col("bin_hi").isNull() & (idx > F.col("bin_lo.bin_idx")), F.lit(False))
    hole = outside | F.coalesce(F.col("bin_hi.alt") - F.col("bin_lo.alt") > p.gap_m, F.lit(False)) | (F.col("bin_lo").isNull() & F.col("bin_hi").isNull())
    return out.withColumn("u", F.coalesce(mix("u"), F.lit(0.0))).withColumn("v", F.coalesce(mix("v"), F.lit(0.0))).withColumn("hole", hole).drop("bin_lo", "bin_hi")


def density_at(points: DataFrame, bins: DataFrame, key=KEY) -> DataFrame:
    """Adds rho at alt: log-linear between measured bins, outside them the standard atmosphere scaled to the edge."""
    out = _around(points, bins, ["rho"], key, F.col("rho") > 0)
    scaled = lambda e: S.std_density(F.col("alt")) * F.col(f"{e}.rho") / S.std_density(F.col(f"{e}.alt"))
    inside = F.col("bin_lo.rho") * F.pow(F.col("bin_hi.rho") / F.col("bin_lo.rho"), (F.col("alt") - F.col("bin_lo.alt")) / (F.col("bin_hi.alt") - F.col("bin_lo.alt")))
    rho = F.when(F.col("bin_lo").isNull() & F.col("bin_hi").isNull(), S.std_density(F.col("alt"))).when(F.col("bin_lo").isNull(), scaled("bin_hi")).when(F.col("bin_hi").isNull(), scaled("bin_lo")).otherwise(inside)
    return out.withColumn("rho", rho).drop("bin_lo", "bin_hi")

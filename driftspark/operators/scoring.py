"""Accuracy and calibration of predictions against landings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.functions import scalars as S
from driftspark.params import DEFAULTS, Params

FLIGHT = ("serial", "launch_t")
SCALES = (0.5, 1.0, 1.5, 2.0)


def truth_ok(flights: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Flights whose last fix can stand for a landing: they have fallen far enough."""
    return flights.where(F.col("max_alt") - F.col("last_alt") >= p.truth_min_fall_m)


def score(landings: DataFrame, predictions: DataFrame, key=FLIGHT) -> DataFrame:
    """One row per prediction of a landed flight: its error, whether it was inside its radius, error over radius."""
    j = landings.select(*key, F.col("land_lat").alias("true_lat"), F.col("land_lon").alias("true_lon"), "landed_t").join(predictions, list(key))
    error = S.haversine_km(F.col("land_lat"), F.col("land_lon"), F.col("true_lat"), F.col("true_lon"))
    j = j.withColumn("error_km", error).withColumn("inside", F.col("error_km") <= F.col("uncertainty_radius_km"))
    j = j.withColumn("bucket", S.alt_bucket(F.coalesce("alt_at_pred", F.lit(0.0))))
    return j.withColumn("ratio", F.when(F.col("uncertainty_radius_km") > 0, F.col("error_km") / F.col("uncertainty_radius_km")))


def drop_suspect(scores: DataFrame, p: Params = DEFAULTS, key=FLIGHT) -> DataFrame:
    """Without flights that were still predicted long after their recorded landing. A group per flight, no window over rows."""
    late = scores.groupBy(*key).agg((F.max("predicted_t") - F.max("landed_t")).alias("lag")).where(F.col("lag") > p.suspect_truth_s)
    return scores.join(late, list(key), "left_anti")


def accuracy(scores: DataFrame, key=FLIGHT) -> DataFrame:
    """One row: flights, predictions, mean error of each flight's last prediction, share inside the radius."""
    last = scores.groupBy(*key).agg(F.max_by("error_km", "predicted_t").alias("final"), F.count("*").alias("n"), F.count_if("inside").alias("inside"))
    return last.agg(F.count("*").alias("n_flights"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_predictions"), F.avg("final").alias("mean_final_error_km"), (F.sum("inside") / F.sum("n")).alias("inside_rate"))


def accuracy_by_bucket(scores: DataFrame) -> DataFrame:
    """All altitude buckets, those without predictions too."""
    names = scores.sparkSession.createDataFrame([(b[0],) for b in S.BUCKETS], "bucket string")
    by = scores.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("error_km").alias("mean_error_km"))
    return names.join(by, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "mean_error_km")


def calibration(scores: DataFrame) -> DataFrame:
    """Coverage and the factor on all radii that would cover the target share: overall, by bucket and by source, in one pass."""
    r = scores.where("ratio is not null")
    sets = r.groupingSets([[], ["bucket"], ["source"]], "bucket", "source").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg((F.col("ratio") <= 1).cast("int")).alias("cover"), F.percentile("ratio", DEFAULTS.quantile).alias("r_scale"))
    kind = F.when(F.col("g") == 3, F.lit("all")).when(F.col("g") == 1, F.lit("bucket")).otherwise(F.lit("source"))
    return sets.select(kind.alias("kind"), F.coalesce("bucket", "source", F.lit("all")).alias("name"), "n", "cover", "r_scale")


def reliability(scores: DataFrame, scales=SCALES) -> DataFrame:
    r = scores.where("ratio is not null").withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    return r.groupBy("scale").agg(F.avg((F.col("ratio") <= F.col("scale")).cast("int")).alias("cover"))


def ablation(scores: DataFrame, key=FLIGHT) -> tuple[DataFrame, DataFrame]:
    """scores with a mode column to a comparison row per mode, and a flight-by-mode matrix of final errors."""
    last = scores.groupBy("mode", *key).agg(F.max_by("error_km", "predicted_t").alias("final"), F.count("*").alias("n"), F.count_if("inside").alias("inside"))
    table = last.groupBy("mode").agg(F.count("*").alias("n_flights"), F.avg("final").alias("mean_final_error_km"), (F.sum("inside") / F.sum("n")).alias("inside_rate"))
    return table, last.groupBy(*key).pivot("mode").agg(F.first("final"))

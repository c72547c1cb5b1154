"""Forecast grids: inventory from file names, windows, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3600.0
# Patterns of file names (cycle hour, forecast hour, day).
CYCLE_HOUR, FORECAST_HOUR, DAY = r"\.t(\d{2})z\.", r"(?:\.f|wrf(?:prs|sfc|nat)f)(\d{2,3})(?:$|[._])", r"(20\d{6})"


def grid_inventory(paths: DataFrame) -> DataFrame:
    """(path) to (path, cycle_t, fxx, valid_t): cycle hour and forecast hour from the file's name, the day from the last date in
    the path; index files and names that don't match are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    hour = F.regexp_extract(name, CYCLE_HOUR, 1)
    fxx = F.regexp_extract(name, FORECAST_HOUR, 1)
    days = F.regexp_extract_all("path", F.lit(DAY), F.lit(1))
    p = paths.select("path", hour.alias("h"), fxx.alias("f"), F.try_element_at(days, F.when(F.size(days) > 0, F.lit(-1))).alias("d"))
    p = p.where("h <> '' and f <> '' and d is not null and not endswith(path, '.idx')")
    p = p.withColumn("day", F.try_to_timestamp("d", F.lit("yyyyMMdd"))).where("day is not null")
    cycle = F.unix_timestamp("day") + F.col("h").cast("int") * HOUR
    return p.select("path", cycle.cast("double").alias("cycle_t"), F.col("f").cast("int").alias("fxx"), (cycle + F.col("f").cast("int") * HOUR).cast("double").alias("valid_t"))


def wind_window(grid: DataFrame, centres: DataFrame, half_deg: float) -> DataFrame:
    """grid (lat, lon, …) cells within ±half_deg of a centre (centre_id, lat, lon), across the seam; joined by cells of that size."""
    n = max(1, int(360 // (2 * half_deg)))
    step = 360.0 / n
    col = lambda x: F.floor(F.pmod(x, F.lit(360.0)) / step)
    g = grid.withColumn("gy", F.floor(F.col("lat") / (2 * half_deg))).withColumn("gx", col(F.col("lon")))
    c = centres.select("centre_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    gy = F.sequence(F.floor((F.col("c_lat") - half_deg) / (2 * half_deg)), F.floor((F.col("c_lat") + half_deg) / (2 * half_deg)))
    c = c.withColumn("gy", F.explode(gy)).withColumn("gx", F.explode(F.array_distinct(F.array(col(F.col("c_lon") - half_deg), col(F.col("c_lon")), col(F.col("c_lon") + half_deg)))))
    near = (F.abs(F.col("lat") - F.col("c_lat")) <= half_deg) & (F.pmod(F.col("lon") - (F.col("c_lon") - half_deg), F.lit(360.0)) <= 2 * half_deg)
    return g.join(c, ["gy", "gx"]).where(near).drop("gy", "gx", "c_lat", "c_lon")


def expired_cycles(inventory: DataFrame, now_t: float, keep_hours: float) -> DataFrame:
    """Inventory rows older than keep_hours; 0 keeps all."""
    return inventory.where(F.lit(keep_hours > 0) & (F.col("cycle_t") < now_t - keep_hours * HOUR))

"""Which forecast cycles a point may use and which a backtest needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions import scalars as S
from driftspark.params import DEFAULTS, Params
from driftspark.sources.grids import HOUR

DAY = 86_400


def pick_cycle(points: DataFrame, inventory: DataFrame, latency_h: float = DEFAULTS.latency_h) -> DataFrame:
    """points (t, …) with cycle_t, the newest cycle published by then; null if there is none, never a later one. The cycles are
    joined by the day: a row for each day of the calendar has that day's cycles and the newest one before."""
    day = lambda t: F.floor(t / DAY)
    cycles = inventory.select("cycle_t").where("cycle_t is not null").distinct().groupBy(day(F.col("cycle_t")).alias("day")).agg(F.sort_array(F.collect_list("cycle_t")).alias("cycles"))
    first, last = cycles.agg(F.min("day"), F.max("day")).first()
    calendar = inventory.sparkSession.range(first or 0, (last if last is not None else -1) + 1).withColumnRenamed("id", "day").join(cycles, "day", "left")
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day: a century has 36,525
    calendar = calendar.select("day", "cycles", F.max(F.element_at("cycles", -1)).over(before).alias("before"))
    cut = F.col("t") - latency_h * HOUR
    out = points.withColumn("day", F.least(day(cut), F.lit(last))).join(calendar, "day", "left")
    past = F.filter("cycles", lambda c: c <= F.col("t") - latency_h * HOUR)
    return out.withColumn("cycle_t", F.coalesce(F.try_element_at(past, F.when(F.size(past) > 0, F.size(past))), "before")).drop("day", "cycles", "before")


def bracket(points: DataFrame, inventory: DataFrame) -> DataFrame:
    """points (t, cycle_t) with lo_t and hi_t, the cycle's valid times around t (clamped at its ends), and w, t's place between.
    The valid times of a cycle are an array of some hundred numbers, joined on the cycle."""
    times = inventory.groupBy("cycle_t").agg(F.array_sort(F.collect_set("valid_t")).alias("valid"))
    j = points.join(times, "cycle_t")
    lo, hi = F.filter("valid", lambda v: v <= F.col("t")), F.filter("valid", lambda v: v >= F.col("t"))
    j = j.withColumn("lo_t", F.coalesce(F.try_element_at(lo, F.when(F.size(lo) > 0, F.size(lo))), F.col("valid")[0])).withColumn("hi_t", F.coalesce(F.get(hi, 0), F.element_at("valid", -1)))
    w = F.when(F.col("hi_t") > F.col("lo_t"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") - F.col("lo_t")) / (F.col("hi_t") - F.col("lo_t"))))).otherwise(F.lit(0.0))
    return j.withColumn("w", w).drop("valid")


def flight_extent(frames: DataFrame, truth: DataFrame | None = None, key=("serial",)) -> DataFrame:
    """(flight, t_lo, t_hi, min_lat, max_lat, min_lon, max_lon) of the frames and the true landing."""
    e = frames.groupBy(*key).agg(*(f(c).alias(n) for f, c, n in ((F.min, "t", "t_lo"), (F.max, "t", "t_hi"), (F.min, "lat", "min_lat"), (F.max, "lat", "max_lat"), (F.min, "lon", "min_lon"), (F.max, "lon", "max_lon"))))
    if truth is None:
        return e
    j = e.join(truth.select(*key, "truth_lat", "truth_lon"), list(key), "left")
    grow = lambda f, c, t: f(c, t).alias(c)
    return j.select(*key, "t_lo", "t_hi", grow(F.least, "min_lat", "truth_lat"), grow(F.greatest, "max_lat", "truth_lat"), grow(F.least, "min_lon", "truth_lon"), grow(F.greatest, "max_lon", "truth_lon"))


def plan_cycles(extents: DataFrame, cached: DataFrame, cycle_h: float = 6.0, max_fxx: int = 120, latency_h: float = DEFAULTS.latency_h, pad_h: float = 2.0, margin_km: float = 75.0) -> tuple[DataFrame, DataFrame]:
    """(cycles, missing): per cycle the forecast hours, box and serials that the flights need, and the (cycle_t, fxx) not in
    ``cached``."""
    cut = F.col("t_lo") - latency_h * HOUR
    cycle = F.floor(cut / 86_400) * 86_400 + F.floor((cut - F.floor(cut / 86_400) * 86_400) / (cycle_h * HOUR)) * (cycle_h * HOUR)
    e = extents.withColumn("cycle_t", cycle.cast("double"))
    hi = F.least(F.ceil((F.col("t_hi") + pad_h * HOUR - F.col("cycle_t")) / HOUR), F.lit(max_fxx)).cast("int")
    e = e.withColumn("hi", hi).withColumn("lo", F.least(F.greatest(F.lit(0), F.floor((F.col("t_lo") - F.col("cycle_t")) / HOUR)), F.col("hi")).cast("int"))
    e = e.withColumn("box", S.expand_box(F.struct("min_lat", "max_lat", "min_lon", "max_lon"), margin_km))
    plan = e.groupBy("cycle_t").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("box.min_lat").alias("min_lat"), F.max("box.max_lat").alias("max_lat"),
        F.min("box.min_lon").alias("min_lon"), F.max("box.max_lon").alias("max_lon"), F.count("*").alias("n_flights"),
    )
    need = plan.select("cycle_t", F.explode(F.sequence("lo", "hi")).alias("fxx"))
    return plan, need.join(cached.select("cycle_t", "fxx"), ["cycle_t", "fxx"], "left_anti")


def missing(need: DataFrame, have: DataFrame, absent: DataFrame, on: list[str]) -> DataFrame:
    """Needed keys that are neither there nor known not to exist."""
    return need.join(have, on, "left_anti").join(absent, on, "left_anti")

"""Per-flight ordered computations: segments, vertical rate, burst, float, launch site. Frames are unique by flight and t."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftspark.functions import scalars as S
from driftspark.params import DEFAULTS, Params

KEY = ("serial",)


def ordered(key=KEY):
    return W.partitionBy(*key).orderBy("t")


def segments(frames: DataFrame, key=KEY) -> DataFrame:
    """Adds seg: kinematics from the frame before (null for the first, or where time doesn't advance)."""
    a = F.lag(F.struct("t", "lat", "lon", "alt")).over(ordered(key))
    out = frames.withColumn("prev", a)
    dt = F.col("t") - F.col("prev.t")
    metre = S.EARTH_KM * 1000
    v = metre * F.radians(F.col("lat") - F.col("prev.lat")) / dt
    u = metre * F.cos(F.radians((F.col("prev.lat") + F.col("lat")) / 2)) * F.radians(S.lon_delta(F.col("lon"), F.col("prev.lon"))) / dt
    seg = F.struct(
        dt.alias("dt"), ((F.col("prev.alt") + F.col("alt")) / 2).alias("alt_mid"), ((F.col("alt") - F.col("prev.alt")) / dt).alias("vrate"),
        u.alias("u"), v.alias("v"), F.sqrt(u * u + v * v).alias("speed"),
        ((F.col("prev.lat") + F.col("lat")) / 2).alias("lat_mid"), S.wrap_lon(F.col("prev.lon") + S.lon_delta(F.col("lon"), F.col("prev.lon")) / 2).alias("lon_mid"),
        ((F.col("prev.t") + F.col("t")) / 2).alias("t_mid"),
    )
    return out.withColumn("seg", F.when(dt > 0, seg)).drop("prev")


def plausible(p: Params = DEFAULTS):
    """Condition on seg: long enough, and no faster than a balloon can be."""
    return F.coalesce((F.col("seg.dt") >= p.min_dt_s) & (F.col("seg.speed") <= p.max_speed_mps) & (F.abs("seg.vrate") <= p.max_vrate_mps), F.lit(False))


def vertical_rate(frames: DataFrame, p: Params = DEFAULTS, key=KEY) -> DataFrame:
    """Adds vrate: least-squares slope of the last seconds, else the segment's rate (needs seg)."""
    w = ordered(key).rangeBetween(-p.rate_window_s, 0)
    enough = (F.count("*").over(w) >= p.rate_min_points) & (F.max("t").over(w) - F.min("t").over(w) >= p.rate_min_span_s)
    return frames.withColumn("vrate", F.coalesce(F.when(enough, F.regr_slope("alt", "t").over(w)), F.col("seg.vrate")))


def rated(frames: DataFrame, p: Params = DEFAULTS, key=KEY) -> DataFrame:
    """One shuffle by flight for both: the windows share partitioning and order."""
    return vertical_rate(segments(frames, key), p, key)


def burst_events(rates: DataFrame, ground: float = 0.0, p: Params = DEFAULTS, key=KEY) -> DataFrame:
    """(flight, burst_t, burst_alt): first frame that ends a run of frames well under the running maximum and falling.

    burst_alt is null for flights first heard falling."""
    w = ordered(key)
    falling = (F.col("alt") < F.col("top") - p.burst_drop_m) & (F.col("vrate") < 0)
    out = rates.withColumn("top", F.max("alt").over(w)).withColumn("first_alt", F.first("alt").over(w))
    out = out.withColumn("run", F.sum(F.coalesce(falling, F.lit(False)).cast("int")).over(w.rowsBetween(1 - p.burst_frames, 0)))
    hit = out.where((F.col("run") == p.burst_frames) & (F.col("top") >= ground + p.airborne_agl_m))
    first = hit.groupBy(*key).agg(F.min_by(F.struct("t", "top", "first_alt"), "t").alias("b"))
    return first.select(*key, F.col("b.t").alias("burst_t"), F.when(F.col("b.top") - F.col("b.first_alt") >= p.ascent_gain_m, F.col("b.top")).alias("burst_alt"))


def float_events(rates: DataFrame, p: Params = DEFAULTS, key=KEY) -> DataFrame:
    """(flight, float_t, float_alt): when a run of slow frames at height has lasted long enough (gaps and islands)."""
    w = ordered(key)
    slow = F.coalesce((F.col("alt") >= p.float_min_alt_m) & (F.abs("vrate") < p.float_rate_mps), F.lit(False))
    out = rates.withColumn("slow", slow)
    out = out.withColumn("island", F.sum((~F.col("slow")).cast("int")).over(w)).where("slow")
    out = out.withColumn("since", F.min("t").over(W.partitionBy(*key, "island")))
    return out.where(F.col("t") - F.col("since") >= p.float_window_s).groupBy(*key).agg(F.min("t").alias("float_t"), F.min_by("alt", "t").alias("float_alt"))


def launch_site(frames: DataFrame, ground: float = 0.0, p: Params = DEFAULTS, key=KEY) -> DataFrame:
    """(flight, first_t, launch_lat, launch_lon): the first fix, if it is near the ground."""
    first = frames.groupBy(*key).agg(F.min_by(F.struct("t", "lat", "lon", "alt"), "t").alias("f"))
    low = F.col("f.alt") <= ground + p.launch_agl_m
    return first.select(*key, F.col("f.t").alias("first_t"), F.when(low, F.col("f.lat")).alias("launch_lat"), F.when(low, F.col("f.lon")).alias("launch_lon"))


def ascent_rate(rates: DataFrame, bursts: DataFrame, key=KEY) -> DataFrame:
    """(flight, ascent_rate): upper median of the positive rates before the burst; null under 5 of them."""
    rising = rates.join(bursts, list(key), "left").where((F.col("vrate") > 0) & (F.col("burst_t").isNull() | (F.col("t") < F.col("burst_t"))))
    return rising.groupBy(*key).agg(F.when(F.count("*") >= 5, S.upper_median(F.col("vrate"))).alias("ascent_rate"))


def assign_flights(frames: DataFrame, gap_s: float = 21_600.0, landings: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Adds flight (from 1) and launch_day, the day of the flight's first frame. Flights of one serial are parted by long silence; with
    landings (serial, landed_t, land_alt) also where the serial, once landed, stays well above where it landed for some frames in a
    row: the last of these begins the new flight. All by windows over one shuffle by serial."""
    w = W.partitionBy("serial").orderBy("t")
    if landings is None:
        out = frames.withColumn("new", F.coalesce(F.col("t") - F.lag("t").over(w) > gap_s, F.lit(True)))
    else:
        marks = landings.where("landed_t is not null").select("serial", F.col("landed_t").cast("double").alias("t"), F.col("land_alt").alias("anchor"), F.lit(1).alias("mark"))
        both = frames.withColumn("t", F.col("t").cast("double")).unionByName(marks, allowMissingColumns=True).withColumn("mark", F.coalesce("mark", F.lit(0)))
        order = W.partitionBy("serial").orderBy("t", "mark")
        before = F.last(F.when(F.col("mark") == 0, F.col("t")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
        both = both.withColumn("new", (F.col("mark") == 0) & F.coalesce(F.col("t") - before > gap_s, F.lit(True)))
        # a phase begins with a landing or a new flight; only one that begins with a landing has an anchor
        both = both.withColumn("phase", F.sum(((F.col("mark") == 1) | F.col("new")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
        phase = W.partitionBy("serial", "phase").orderBy("t", F.desc("mark"))
        both = both.withColumn("anchor", F.first("anchor").over(phase.rowsBetween(W.unboundedPreceding, 0))).where("mark = 0")
        high = F.coalesce(F.col("alt") > F.col("anchor") + p.reascent_m, F.lit(False)).cast("int")
        both = both.withColumn("run", F.sum(high).over(phase.rowsBetween(1 - p.sustained_frames, 0)) == p.sustained_frames)
        first = F.col("run") & (F.sum(F.col("run").cast("int")).over(phase.rowsBetween(W.unboundedPreceding, 0)) == 1)
        out = both.withColumn("new", F.col("new") | first).select(*frames.columns, "new")
    out = out.withColumn("flight", F.sum(F.col("new").cast("int")).over(w)).drop("new")
    first = F.min("t").over(W.partitionBy("serial", "flight"))
    return out.withColumn("launch_day", F.date_from_unix_date(F.floor(first / 86_400).cast("int")))

"""Queries over the stored tables: latest predictions, lists, pages, deletions, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("serial", "launch_t")


def active(flights: DataFrame) -> DataFrame:
    return flights.where("state <> 'LANDED'")


def recent(flights: DataFrame, n: int, include_landed: bool = True) -> DataFrame:
    """The n flights heard last (a top-n, not a sort); ties by serial."""
    return (flights if include_landed else active(flights)).orderBy(F.desc("last_seen_t"), "serial").limit(n)


def latest_predictions(predictions: DataFrame, key=KEY) -> DataFrame:
    """Each flight's latest predictions; ties are kept."""
    w = W.partitionBy(*key).orderBy(F.desc("predicted_t"))
    return predictions.withColumn("rk", F.rank().over(w)).where("rk = 1").drop("rk")


def latest_predictions_active(flights: DataFrame, predictions: DataFrame, key=KEY) -> DataFrame:
    return latest_predictions(predictions.join(active(flights).select(*key), list(key), "left_semi"), key)


def latest_paths_active(flights: DataFrame, paths: DataFrame, key=KEY) -> DataFrame:
    return paths.join(active(flights).select(*key), list(key), "left_semi")


def tracks_active(flights: DataFrame, track: DataFrame, key=("serial",)) -> DataFrame:
    """(flight, points): the flown track of each flight in the air, ordered by time. A flight has at most some thousand points."""
    t = track.join(active(flights).select(*key), list(key), "left_semi")
    return t.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "lat", "lon", "alt"))), lambda x: F.struct(x["lat"], x["lon"], x["alt"])).alias("points"))


def recent_landings(landings: DataFrame, flights: DataFrame, n: int, key=KEY) -> DataFrame:
    top = landings.orderBy(F.desc("landed_t"), "serial").limit(n)
    return top.join(flights.select(*key, "type"), list(key), "left")


def recent_alerts(alerts: DataFrame, subscribers: DataFrame, flights: DataFrame, n: int, offset: int = 0) -> DataFrame:
    top = alerts.orderBy(F.desc("sent_t"), "serial", "subscriber_id", "alert_type").offset(offset).limit(n)
    named = top.join(subscribers.select(F.col("id").alias("subscriber_id"), "units"), "subscriber_id", "left")
    return named.join(flights.select("serial", "type"), "serial", "left")


def flights_with_prediction(flights: DataFrame, predictions: DataFrame, key=KEY) -> DataFrame:
    """Every flight and its latest prediction as a struct, or null."""
    last = predictions.groupBy(*key).agg(F.max_by(F.struct("predicted_t", "land_lat", "land_lon", "land_t", "source", "uncertainty_radius_km"), "predicted_t").alias("prediction"))
    return flights.join(last, list(key), "left")


def prediction_history(predictions: DataFrame, landings: DataFrame, key=KEY) -> DataFrame:
    """Each prediction's distance to the flight's reference: its landing, else its latest prediction."""
    from driftspark.functions.scalars import haversine_km

    w = W.partitionBy(*key).orderBy("predicted_t").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    p = predictions.withColumn("last", F.last(F.struct("land_lat", "land_lon")).over(w))
    j = p.join(landings.select(*key, F.col("land_lat").alias("true_lat"), F.col("land_lon").alias("true_lon")), list(key), "left")
    d = haversine_km(F.col("land_lat"), F.col("land_lon"), F.coalesce("true_lat", "last.land_lat"), F.coalesce("true_lon", "last.land_lon"))
    return j.withColumn("to_reference_km", d).drop("last", "true_lat", "true_lon")


def page(df: DataFrame, order: list, n: int, offset: int = 0) -> DataFrame:
    """One page of the rows and the total; the total is an aggregate of its own, not a window over all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(n).join(F.broadcast(total))  # one row


def clear_alerts(alerts: DataFrame, flights: DataFrame) -> DataFrame:
    """What is left: alerts of flights still in the air."""
    return alerts.join(active(flights).select("serial"), "serial", "left_semi")


def clear_accuracy(predictions: DataFrame, flights: DataFrame, key=KEY) -> DataFrame:
    """What is left: predictions of flights that aren't finished."""
    return predictions.join(flights.where("state = 'LANDED'").select(*key), list(key), "left_anti")


def retract_landing(landings: DataFrame, alerts: DataFrame, retracted: DataFrame, key=KEY) -> tuple[DataFrame, DataFrame]:
    """Landings and alerts without those of the retracted flights; of their alerts only LANDED ones go."""
    gone = retracted.select("serial").distinct().withColumn("gone", F.lit(True))
    left = alerts.join(gone, "serial", "left").where("gone is null or alert_type <> 'LANDED'").drop("gone")
    return landings.join(retracted.select(*key), list(key), "left_anti"), left


def delete_flights(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the doomed serials; rows without a serial stay."""
    return {name: df.join(doomed.select("serial"), "serial", "left_anti") for name, df in tables.items()}


def stats(flights: DataFrame, subscribers: DataFrame, alerts: DataFrame, now_t: float, n: str | None = None) -> DataFrame:
    """One row of counts and the age of the last frame. n: the column that says how many alerts a row stands for, if not one."""
    f = flights.agg(F.count_if(F.col("state") != "LANDED").alias("active_flights"), (F.lit(now_t) - F.max("last_seen_t")).alias("last_frame_age_s"))
    return f.join(F.broadcast(subscribers.agg(F.count_if("active").alias("subscribers")))).join(F.broadcast(alerts.agg((F.count("*") if n is None else F.coalesce(F.sum(n), F.lit(0))).alias("alerts"))))  # one row each


def track_burst(track: DataFrame, bursts: DataFrame, key=("serial",)) -> DataFrame:
    """(flight, lat, lon, alt): the track's highest point, where a burst was recorded, with the recorded altitude."""
    top = track.groupBy(*key).agg(F.max_by(F.struct("lat", "lon"), F.struct("alt", F.col("t") * -1)).alias("p"))
    return top.join(bursts.where("burst_alt is not null"), list(key)).select(*key, "p.lat", "p.lon", F.col("burst_alt").alias("alt"))


def map_features(flights: DataFrame, track: DataFrame, predictions: DataFrame, landings: DataFrame, subscribers: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(kind, serial, geometry, properties): what a map shows; lines of fewer than two points are left out."""
    out = "kind", "serial", "geometry", "properties"
    point = lambda lat, lon: F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 6), F.round(lat, 6)).alias("coordinates")))
    row = lambda df, kind, serial, geometry, *props: df.select(F.lit(kind).alias("kind"), serial.alias("serial"), geometry.alias("geometry"), F.to_json(F.struct(*props)).alias("properties")).select(*out)
    air = active(flights)
    line = lambda xs: F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(xs, lambda x: F.array(F.round(x["lon"], 6), F.round(x["lat"], 6))).alias("coordinates")))
    flown = tracks_active(flights, track).join(air.select("serial", "last_lat", "last_lon", "last_alt"), "serial")
    flown = flown.withColumn("points", F.array_append("points", F.struct(F.col("last_lat").alias("lat"), F.col("last_lon").alias("lon"), F.col("last_alt").alias("alt"))))
    parts = [
        row(air.where("launch_lat is not null"), "launch", F.col("serial"), point(F.col("launch_lat"), F.col("launch_lon")), "type"),
        row(air, "flight", F.col("serial"), point(F.col("last_lat"), F.col("last_lon")), "type", "state", F.round("last_alt", 1).alias("alt")),
        row(flown.where(F.size("points") > 1), "track", F.col("serial"), line(F.col("points")), F.size("points").alias("n")),
        row(latest_predictions_active(flights, predictions), "prediction", F.col("serial"), point(F.col("land_lat"), F.col("land_lon")), "source", F.round("uncertainty_radius_km", 3).alias("radius_km")),
        row(landings, "landing", F.col("serial"), point(F.col("land_lat"), F.col("land_lon")), "detected_by"),
        row(subscribers.where("active"), "subscriber", F.col("id").cast("string"), point(F.col("lat"), F.col("lon")), F.round("radius_km", 3).alias("radius_km")),
    ]
    if paths is not None:
        p = paths.join(air.select("serial", "last_lat", "last_lon", "last_alt"), "serial")
        live = F.struct(F.col("last_lat").alias("lat"), F.col("last_lon").alias("lon"), F.col("last_alt").alias("alt"))
        p = p.withColumn("path", F.concat(F.array(live), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))))
        parts.append(row(p.where(F.size("path") > 1), "path", F.col("serial"), line(F.col("path")), F.size("path").alias("n")))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every


def merge_history(history: DataFrame, live: DataFrame) -> DataFrame:
    """Fetched history, one frame per time, and the live frames newer than its last."""
    h = history.withColumn("rn", F.row_number().over(W.partitionBy("serial", "t").orderBy("frame"))).where("rn = 1").drop("rn")
    last = h.groupBy("serial").agg(F.max("t").alias("last_t"))
    newer = live.join(last, "serial", "left").where("last_t is null or t > last_t").select(*history.columns)
    return h.unionByName(newer)


def to_json_rows(rows: DataFrame, keys: list[str], order: str, name: str = "json") -> DataFrame:
    """(keys, <name>): a flight's rows (profile bins, descent samples, a path) as one JSON array in their order; nulls are written. A flight has
    some thousand at most."""
    rest = [order, *(c for c in rows.columns if c not in (*keys, order))]
    many = F.sort_array(F.collect_list(F.struct(*rest)))
    return rows.groupBy(*keys).agg(F.to_json(many, {"ignoreNullFields": "false"}).alias(name))


def from_json_rows(texts: DataFrame, schema: str, keys: list[str], name: str = "json") -> DataFrame:
    """The rows again; schema: those of an array's element (``bin_idx long, u double, …``). Texts that are no such array give none."""
    return texts.select(*keys, F.inline(F.from_json(name, f"array<struct<{', '.join(':'.join(c.split()) for c in schema.split(','))}>>")))

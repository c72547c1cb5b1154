"""Backtests: frames of whole archives to predictions at a cadence, scored against the true landings, as one job."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.operators import drift, landing, scoring, winds
from driftspark.operators.flights import fold_frames
from driftspark.params import DEFAULTS, Params
from driftspark.sources.scratch import saved


def origins(frames: DataFrame, every_s: float = 0.0, p: Params = DEFAULTS, refresh_caps: tuple = ()) -> DataFrame:
    """What a prediction may know, for each ``every_s`` seconds of each descent (0: each cadence of the parameters), with an id.
    refresh_caps: see ``fold_frames``."""
    paced = dataclasses.replace(p, cadence_s=max(p.cadence_s, every_s))
    o = fold_frames(frames, paced, kinds=("ORIGIN",), refresh_caps=refresh_caps).where("b is not null")
    return o.withColumn("origin_id", F.concat_ws("|", "serial", F.col("launch_t").cast("long"), F.col("t").cast("long"))).withColumn("ground", F.lit(0.0))


def last_fix(frames: DataFrame) -> DataFrame:
    return frames.groupBy("serial").agg(F.max_by(F.struct("t", "lat", "lon", "alt"), "t").alias("f")).select("serial", F.col("f.lat").alias("truth_lat"), F.col("f.lon").alias("truth_lon"), F.col("f.alt").alias("truth_alt"))


def backtest(frames: DataFrame, truth: DataFrame, every_s: float = 60.0, members: int = 0, p: Params = DEFAULTS, model=None, use: str = "measured") -> DataFrame:
    """Scores of all predictions (see ``scoring``), each made with what was known at its time. model and use: see ``wind_of``."""
    return scored(predicted(origins(frames, every_s, p), members, p, model, use), truth)


def predicted(o: DataFrame, members: int = 0, p: Params = DEFAULTS, model=None, use: str = "measured") -> DataFrame:
    wind = wind_of(o, use, model, p)
    return landing.predict(o, members, p, wind=wind, source="measured" if wind is None else "gfs")


def scored(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """truth has a row for each serial, so predictions are joined to it as they are and made once."""
    lands = truth.select("serial", F.col("truth_lat").alias("land_lat"), F.col("truth_lon").alias("land_lon"), F.lit(None).cast("double").alias("landed_t"))
    return scoring.score(lands, predictions, ("serial",))


def wind_of(o: DataFrame, use: str, model, p: Params = DEFAULTS):
    """The layers' wind for ``landing.land``. model is a ``drift.Formula``, or adds mu, mv to rows with lat, lon, alt, at (time); use is
    measured (None), model, blend (the origin's bins by distance and age) or bias (the model shifted by what was measured against it)."""
    if model is None or use == "measured":
        return None
    if isinstance(model, drift.Formula):
        return drift.Wind(model, use)
    if use == "model":
        return lambda rows: model(rows).withColumn("u", F.coalesce("mu", "u")).withColumn("v", F.coalesce("mv", "v"))
    bins = o.select("origin_id", F.explode("bins").alias("b")).select("origin_id", "b.*").withColumn("alt", (F.col("bin_idx") + 0.5) * p.bin_m)
    bias = use == "bias"
    if bias:
        bins = model(bins.withColumn("at", F.col("t"))).withColumnsRenamed({"mu": "bmu", "mv": "bmv"})

    def wind(rows: DataFrame) -> DataFrame:
        out = winds.blended_wind(model(rows).withColumn("t", F.col("at")), bins, p, ("origin_id",), bias)
        return out.withColumn("u", F.col("wu")).withColumn("v", F.col("wv"))

    return wind


def modes(fine, coarse, p: Params = DEFAULTS) -> dict[str, dict]:
    """The six ways of the ablation: what ``backtest`` takes for each. fine: the composite model, coarse: the one without it."""
    fixed = dataclasses.replace(p, refresh_cap=10**9)
    return {
        "measured-only": {"p": p},
        "model-only": {"p": p, "model": fine, "use": "model"},
        "blend": {"p": fixed, "model": fine, "use": "blend"},
        "blend+refresh": {"p": p, "model": fine, "use": "blend"},
        "bias+refresh": {"p": p, "model": fine, "use": "bias"},
        "gfs-only": {"p": p, "model": coarse, "use": "blend"},
    }


def ablate(frames: DataFrame, truth: DataFrame, how: dict[str, dict], every_s: float = 60.0) -> DataFrame:
    """Scores of the same frames under several modes (see ``modes``), with a mode column, made once and written to the shared folder. Modes
    whose model is none or a formula go over the frames together, in one fold for those that differ in the refresh cap alone. Any
    other has its predictions made and written by itself, from origins that modes of the same parameters share."""
    together, made, folded = {}, [], {}
    for mode, given in how.items():
        p, wind = given.get("p", DEFAULTS), given.get("model")
        if set(given) <= {"p", "model", "use"} and (wind is None or isinstance(wind, drift.Formula)):
            together.setdefault(dataclasses.replace(p, refresh_cap=0), {})[mode] = p.refresh_cap, wind_of(None, given.get("use", "measured"), wind, p)
            continue
        if p not in folded:
            folded[p] = saved(origins(frames, every_s, p), "origins")
        made.append(saved(predicted(folded[p], **given), "predictions").withColumn("mode", F.lit(mode)))
    for p, ways in together.items():
        caps = tuple(dict.fromkeys(cap for cap, _ in ways.values()))
        made.append(landing.predict_by(origins(frames, every_s, p, caps), ways, p).withColumnRenamed("way", "mode"))
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    every = scored(every, truth)
    return saved(every.select(*(c for c in every.columns if c != "mode"), "mode"), "scores")

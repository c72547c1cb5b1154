"""Flights rebuilt from fetched history: which ones, their events anew, and their state handed to a running stream."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.operators import tables
from driftspark.operators.flights import Flight, Fold, _slim, fold_frames, play
from driftspark.params import DEFAULTS, Params


@dataclass
class Serial:
    """What a stream keeps of a serial: its flight, frames that wait for their order, names of frames seen of late."""

    flight: Flight | None = None
    waiting: list = field(default_factory=list)
    seen: dict = field(default_factory=dict)
    released: float | None = None
    ground: float = 0.0
    judged: float = -math.inf  # silence is judged up to then
    hold_until: float = -math.inf
    fold: Fold | None = None
    timers: tuple = ()  # milliseconds at which the stream is to look at the serial


def candidates(flights: DataFrame, now_t: float, p: Params = DEFAULTS) -> DataFrame:
    """flights (serial, launch_t, state, launch_lat, last_seen_t, …) to (serial, launch_t, why): of those not landed the ones first heard in
    mid-air, whose launch site is not known, and the ones that have been silent for a while."""
    why = F.when(F.col("launch_lat").isNull(), F.lit("mid-air")).when(F.lit(now_t) - F.col("last_seen_t") >= p.backfill_silent_s, F.lit("silent"))
    return tables.active(flights).select("serial", "launch_t", why.alias("why")).where("why is not null")


def holds(asked: DataFrame, now_t: float, p: Params = DEFAULTS) -> DataFrame:
    """asked (serial, asked_t): fetches that are under way, to (serial, hold_until); those asked for too long ago hold nothing."""
    until = F.max("asked_t") + p.backfill_hold_s
    return asked.groupBy("serial").agg(until.alias("hold_until")).where(F.col("hold_until") >= now_t)


def rebuilt_frames(history: DataFrame, live: DataFrame) -> DataFrame:
    """Frames of the serials whose history says more than was heard live: it begins earlier or ends later. Live frames follow where history ends."""
    span = lambda df, a, b: df.groupBy("serial").agg(F.min("t").alias(a), F.max("t").alias(b))
    known = span(history, "h0", "h1").join(span(live, "l0", "l1"), "serial", "left")
    useful = known.where("l0 is null or h0 < l0 or h1 > l1").select("serial")
    return tables.merge_history(history.join(useful, "serial", "left_semi"), live.join(useful, "serial", "left_semi"))


def rebuild(events: DataFrame, history: DataFrame, live: DataFrame, p: Params = DEFAULTS, until: float | None = None, held: DataFrame | None = None, kinds=None) -> DataFrame:
    """The events with those of rebuilt serials replaced: their flights are forgotten and the fold runs anew over history and live frames. All
    others stay as they are. Serials in ``held`` are not closed for silence after their last frame. kinds: the kinds of events, if not all."""
    frames = rebuilt_frames(history, live)
    new = fold_frames(frames, p, until, kinds, held)
    return events.join(frames.select("serial").distinct(), "serial", "left_anti").unionByName(new.select(*events.columns))


def seeds(frames: DataFrame, p: Params = DEFAULTS, hold: DataFrame | None = None) -> DataFrame:
    """(serial, blob): the state in which ``streaming.flights.track_stream`` begins, as if it had seen these frames (those with a frame
    number, where given, are known as repeats). hold (serial, hold_until): silence of these serials is not judged before."""
    rows = _slim(frames).join(frames.select("serial", F.col("t").alias("_t"), "frame").groupBy("serial").agg(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_t", "frame"))).alias("names")), "serial") if "frame" in frames.columns else _slim(frames)
    if hold is not None:
        rows = rows.join(hold.select("serial", "hold_until"), "serial", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        serial, fold = Serial(), Fold(str(pdf["serial"].iloc[0]), p)
        _, serial.ground = play(fold, pdf)
        serial.flight, serial.released = fold.f, float(pdf["t"].max())
        if "names" in pdf:
            names = [(x["_t"], x["frame"]) for x in pdf["names"].iloc[0]]
            serial.seen = {n if n is not None else t: t for t, n in names if t >= serial.released - p.dedup_s}
        if "hold_until" in pdf and pd.notna(pdf["hold_until"].iloc[0]):
            serial.hold_until = float(pdf["hold_until"].iloc[0])
        return pd.DataFrame({"serial": [fold.serial], "blob": [pickle.dumps(serial)]})

    return rows.groupBy("serial").applyInPandas(run, "serial string, blob binary")

"""Streams: de-duplication, reordering, the flight fold and alerts with keyed state, and sinks of micro-batches."""

from __future__ import annotations

import math
import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftspark.functions import scalars as S
from driftspark.operators import geofence, terrain
from driftspark.operators.alerts import ALERT, Alerts, tell
from driftspark.operators.flights import FRAME, ROW, Fold, as_rows
from driftspark.operators.rebuild import Serial
from driftspark.params import DEFAULTS, Params


def deduplicated(frames: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Frames without repeats of a serial's frame number (or time) within the watermark."""
    keyed = frames.withColumn("dedup_key", S.dedup_key(F.col("frame"), F.col("dt")))
    return keyed.withWatermark("dt", f"{int(p.dedup_s)} seconds").dropDuplicatesWithinWatermark(["serial", "dedup_key"]).drop("dedup_key")


class Tracker(StatefulProcessor):
    """One serial: drops repeats, holds frames for some seconds of event time, folds them in order, and judges silence by
    event-time timers, so a backlog isn't taken for silence. State may begin with a replayed fold (see ``rebuild.seeds``); until its
    hold ends, silence is not judged. A frame outside the capture box is dropped while the serial has no flight."""

    def __init__(self, p: Params = DEFAULTS, kinds: frozenset | None = None):
        self.p, self.kinds = p, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flight", "blob binary")

    def load(self, key) -> Serial:
        got = self.state.get()
        serial = pickle.loads(got[0]) if got else Serial()
        serial.fold = Fold(key[0], self.p, serial.flight, self.kinds)
        return serial

    def keep(self, serial: Serial) -> None:
        serial.flight, fold, serial.fold = serial.fold.f, serial.fold, None
        due = [serial.waiting[0][0] + self.p.reorder_hold_s] if serial.waiting else []
        if (s := fold.next_silence(serial.judged)) is not None:
            due.append(max(s, serial.hold_until))
        before, serial.timers = serial.timers, tuple(sorted({int(t * 1000) for t in due}))
        if not serial.waiting and serial.flight is None:
            self.state.clear()
        else:
            self.state.update((pickle.dumps(serial),))
        for t in before:  # each call asks the JVM, so timers are not listed
            if t not in serial.timers:
                self.handle.deleteTimer(t)
        for t in serial.timers:
            self.handle.registerTimer(t)

    def release(self, serial: Serial, upto: float) -> list:
        """Folds what has waited long enough."""
        rows = []
        serial.waiting.sort(key=lambda x: x[0])
        while serial.waiting and serial.waiting[0][0] <= upto:
            *x, ground, inside = serial.waiting.pop(0)
            if serial.released is not None and x[0] <= serial.released:
                continue  # older than what has gone on
            if x[0] >= serial.hold_until:
                rows += serial.fold.quiet(x[0], serial.ground)
            rows += serial.fold.frame(tuple(x), ground, inside)
            serial.released, serial.ground, serial.judged, serial.hold_until = x[0], ground, -math.inf, -math.inf
        return rows

    def handleInputRows(self, key, rows, timerValues):
        serial = self.load(key)
        for pdf in rows:
            cols = [[None if y is None or y is pd.NA or y != y else y for y in pdf[c].tolist()] for c in ("frame", *FRAME, "ground", "inside")]
            for n, *x in zip(*cols):
                name = n if n is not None else x[0]
                if name in serial.seen:
                    continue
                serial.seen[name] = x[0]
                serial.waiting.append((*x[:-2], x[-2] or 0.0, bool(x[-1])))
        newest = max([*(x[0] for x in serial.waiting), *serial.seen.values()], default=0.0)
        serial.seen = {k: t for k, t in serial.seen.items() if t >= newest - self.p.dedup_s}
        out = self.release(serial, newest - self.p.reorder_hold_s)
        self.keep(serial)
        if out:
            yield as_rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        serial, now = self.load(key), expiredTimerInfo.getExpiryTimeInMs() / 1000
        out = self.release(serial, now - self.p.reorder_hold_s + 1e-6)
        if serial.fold.f is not None and not serial.waiting and now >= serial.hold_until - 1e-3:
            out += serial.fold.quiet(now + 1e-3, serial.ground)
            serial.judged = now
        self.keep(serial)
        if out:
            yield as_rows(out)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        serial = pickle.loads(initialState["blob"].iloc[0])
        serial.fold = Fold(key[0], self.p, serial.flight, self.kinds)
        self.keep(serial)

    def close(self) -> None:
        pass


def track_stream(frames: DataFrame, p: Params = DEFAULTS, watermark: str = "10 seconds", seeds: DataFrame | None = None, kinds=None) -> DataFrame:
    """A stream of frames (serial, frame, dt, t, lat, lon, alt, pressure, temp[, ground][, inside]) to a stream of the fold's event rows;
    ``with_ground`` and ``with_gate`` add the last two. seeds (serial, blob): flights that the stream begins with, see ``rebuild.seeds``. The session
    needs the RocksDB state store. Timers move with the watermark, so a stream that falls wholly silent needs a heartbeat."""
    have = {"ground": F.lit(0.0), "inside": F.lit(True)} | {c: F.col(c) for c in ("ground", "inside") if c in frames.columns}
    slim = frames.select("serial", "frame", "dt", *FRAME, *(c.alias(n) for n, c in have.items())).withWatermark("dt", watermark)
    tracker = Tracker(p, None if kinds is None else frozenset(kinds))
    begin = None if seeds is None else seeds.select("serial", "blob").groupBy("serial")
    return slim.groupBy("serial").transformWithStateInPandas(statefulProcessor=tracker, outputStructType=ROW, outputMode="Append", timeMode="EventTime", initialState=begin)


def with_ground(frames: DataFrame, cells: DataFrame, fallback: float = 0.0) -> DataFrame:
    """A stream (or a table) of frames with ground, by one join with a table: cells (tile, res, row, col, elev) become one row a tile, whose
    heights lie in an array of rows."""
    return terrain.ground_in_tiles(frames, terrain.tile_arrays(cells), fallback)


def with_gate(frames: DataFrame, roi: DataFrame) -> DataFrame:
    """Frames with ``inside``: whether they lie in the capture box (roi: one row, or none: then nothing does). The fold lets serials that have
    a flight go on outside it. roi is read anew when the query starts; after a change of the circles the query is started
    again on its checkpoint, and flights go on."""
    box = roi.agg(*(F.first(c).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")))  # one row, also where roi has none
    return frames.join(F.broadcast(box)).withColumn("inside", F.coalesce(geofence.inside_box(), F.lit(False))).drop("min_lat", "max_lat", "min_lon", "max_lon")


class Alerter(StatefulProcessor):
    """One subscriber and flight, over matches of predictions and, with column landed, of landings."""

    def __init__(self, p: Params = DEFAULTS):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alerts", "blob binary")

    def handleInputRows(self, key, rows, timerValues):
        got = self.state.get()
        alerts = pickle.loads(got[0]) if got else Alerts()
        out = tell(alerts, pd.concat(list(rows), ignore_index=True), key, self.p)
        self.state.update((pickle.dumps(alerts),))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ALERT.split(", ")])

    def close(self) -> None:
        pass


def alert_stream(found: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return found.groupBy("subscriber_id", "serial", "launch_t").transformWithStateInPandas(statefulProcessor=Alerter(p), outputStructType=ALERT, outputMode="Append", timeMode="None")

"""Streams against batches: terrain, the capture box with state, state handed over, the landing record, sinks that are stopped half way."""

import json

import pytest
from pyspark.sql import functions as F
from test_flights import FRAMES, T0, flight, table

from driftspark.operators import alerts, flights, ledger, rebuild, terrain
from driftspark.params import DEFAULTS
from driftspark.streaming import flights as streaming
from driftspark.streaming import sinks

KIND = "serial string, launch_t double, kind string, t double, state string, lat double, lon double, alt double, max_alt double, detected_by string, seen_t double"


def files(path, rows, n):
    path.mkdir()
    step = len(rows) // n + 1
    for i in range(0, len(rows), step):
        (path / f"{i:06d}.json").write_text("\n".join(json.dumps(dict(zip(("serial", "frame", "t", "lat", "lon", "alt", "pressure", "temp"), r))) for r in rows[i : i + step]))
    return str(path)


def frames_of(spark, path):
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).json(path).withColumn("dt", F.timestamp_seconds("t"))


def run(stream, tmp, name):
    out = str(tmp / name)
    q = stream.writeStream.foreachBatch(sinks.into(sinks.append, out)).option("checkpointLocation", str(tmp / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return stream.sparkSession.read.parquet(out)


def key(df, keep):
    return sorted((r.serial, r.kind, r.t, r.launch_lat is None) for r in df.where(keep).collect())


def cells(spark):
    """A plateau at 2,000 m with a step to 1,000 m, and a tile whose finest grid has a hole."""
    out = [("N45_00_E007_00", 4, y, x, 2000.0 if x < 3 else 1000.0) for y in range(4) for x in range(4)]
    out += [("N45_00_E007_00", 2, y, x, 0.0) for y in range(2) for x in range(2)] + [("N45_00_E008_00", 3, y, x, 1500.0 + 10 * y) for y in range(3) for x in range(3) if (y, x) != (1, 1)]
    return spark.createDataFrame(out, "tile string, res int, row int, col int, elev double")


def test_tiles_as_arrays_give_the_same_ground(spark):
    points = spark.createDataFrame([(k, 45 + (k * 37 % 100) / 100, 7 + (k * 59 % 250) / 100) for k in range(300)], "point_id long, lat double, lon double")
    want = {r.point_id: round(r.ground, 9) for r in terrain.ground_at(points, cells(spark), -5.0).collect()}
    got = {r.point_id: round(r.ground, 9) for r in terrain.ground_in_tiles(points, terrain.tile_arrays(cells(spark)), -5.0).collect()}
    assert got == want and len(set(want.values())) > 20 and -5.0 in want.values()


def test_terrain_and_box_in_a_stream(spark, tmp_path):
    """Over the plateau flights land 2,000 m higher; a serial that leaves the box goes on, one that begins outside leaves nothing until it is inside."""
    rows = [r for k in range(2) for r in flight(f"S{k}", burst=9000, low=2000.0, start=T0 + 7 * k)]
    rows += [(*r[:3], r[3] + 3, *r[4:]) for r in flight("OUT", burst=6000, low=2000.0)]
    late = flight("LATE", burst=6000, low=2000.0)
    rows += [(*r[:3], r[3] + (3 if i < 40 else 0), *r[4:]) for i, r in enumerate(late)]
    leaves = flight("LEAVES", burst=9000, low=2000.0)
    rows += [(*r[:3], r[3], r[4] + 0.002 * max(0, i - 100), *r[5:]) for i, r in enumerate(leaves)]
    rows.sort(key=lambda r: r[2])
    roi = spark.createDataFrame([(44.0, 46.0, 6.0, 7.6)], "min_lat double, max_lat double, min_lon double, max_lon double")
    stream = streaming.with_gate(streaming.with_ground(frames_of(spark, files(tmp_path / "in", rows, 4)), cells(spark)), roi)
    got = run(streaming.track_stream(stream), tmp_path, "out")
    keep = f"kind not in ('TRACK', 'ORIGIN') and t < {rows[-1][2] - 60}"
    df = streaming.with_gate(streaming.with_ground(table(spark, rows), cells(spark)), roi)
    want = key(flights.fold_frames(df), keep)
    assert key(got, keep) == want
    kinds = {s: [k for serial, k, *_ in want if serial == s] for s in ("S0", "OUT", "LATE", "LEAVES")}
    assert kinds["OUT"] == [] and "BURST" in kinds["LEAVES"] and set(kinds["S0"]) == {"NEW_FLIGHT", "BURST", "LANDED"} and kinds["LATE"].count("NEW_FLIGHT") == 1
    began = {r.serial: r.t for r in got.where("kind = 'NEW_FLIGHT'").collect()}
    assert began["LATE"] == late[40][2]
    landed = got.where("kind = 'LANDED' and serial = 'S0'").first()
    assert landed.detected_by == "telemetry" and 1900 < landed.alt <= 2300
    at_sea_level = flights.fold_frames(table(spark, [r for r in rows if r[0] == "S0"])).where("kind = 'LANDED'")
    assert at_sea_level.count() == 0


def test_a_stream_goes_on_from_a_replayed_fold(spark, tmp_path):
    rows = [r for k in range(3) for r in flight(f"S{k}", burst=7000, start=T0 + 7 * k)]
    rows.sort(key=lambda r: r[2])
    half = len(rows) // 2
    end = rows[half - 1][2]
    seeds = rebuild.seeds(table(spark, rows[:half]))
    stream = frames_of(spark, files(tmp_path / "in", rows[half - 20 :], 3))  # twenty frames come again
    got = run(streaming.track_stream(stream, seeds=seeds), tmp_path, "out")
    keep = f"kind not in ('TRACK', 'ORIGIN') and t > {end} and t < {rows[-1][2] - 60}"
    want = key(flights.fold_frames(table(spark, rows)), keep)
    assert key(got, keep) == want and {k[1] for k in want} >= {"BURST"} and not any(k[3] for k in want)


def test_held_serials_are_not_closed(spark, tmp_path):
    rows = flight("A")[:200] + flight("B")[:200]
    held = spark.createDataFrame([("A",)], "serial string")
    late = rows[199][2] + 7000
    got = flights.fold_frames(table(spark, rows), until=late, kinds=flights.EVENTS, held=held).where("kind = 'EXPIRED'").collect()
    assert [r.serial for r in got] == ["B"]
    asked = spark.createDataFrame([("A", late - 100.0), ("A", late - 9000.0), ("C", late - 2000.0)], "serial string, asked_t double")
    assert [(r.serial, r.hold_until) for r in rebuild.holds(asked, late).collect()] == [("A", late - 100.0 + DEFAULTS.backfill_hold_s)]
    # in a stream: other serials' frames move the watermark past A's silence; its hold ends later
    hold = spark.createDataFrame([("A", rows[199][2] + 100_000)], "serial string, hold_until double")
    seeds = rebuild.seeds(table(spark, rows), hold=hold)
    beat = [("C", i, late + 60.0 * i, 45.0, 7.0, 300.0 + 50 * i, None, None) for i in range(60)]
    got = run(streaming.track_stream(frames_of(spark, files(tmp_path / "in", beat, 3)), seeds=seeds), tmp_path, "out").where("kind = 'EXPIRED'").collect()
    assert {r.serial for r in got} == {"B"}


def test_rebuild_replaces_only_what_history_adds_to(spark):
    whole = {s: flight(s, burst=9000) for s in ("MID", "WHOLE", "OTHER", "LOST")}
    top = max(range(len(whole["MID"])), key=lambda i: whole["MID"][i][5])
    heard = whole["MID"][100:] + whole["WHOLE"] + whole["OTHER"] + whole["LOST"][: top - 50]
    live = table(spark, heard)
    fetched = table(spark, whole["MID"][:150] + whole["WHOLE"][10:20] + whole["LOST"])
    as_heard = flights.fold_frames(live, kinds=flights.EVENTS)
    assert {r.serial for r in rebuild.rebuilt_frames(fetched, live).select("serial").distinct().collect()} == {"MID", "LOST"}
    got = rebuild.rebuild(as_heard, fetched, live).where(F.col("kind").isin(*flights.EVENTS))
    want = flights.fold_frames(table(spark, [r for s in whole.values() for r in s]), kinds=flights.EVENTS)
    assert key(got, "true") == key(want, "true") != key(as_heard, "true")
    f = spark.createDataFrame([("MID", 1.0, "ASCENT", None, 900.0), ("LOST", 2.0, "ASCENT", 45.0, 600.0), ("WHOLE", 3.0, "DESCENT", 45.0, 900.0), ("OLD", 4.0, "LANDED", None, 1.0)], "serial string, launch_t double, state string, launch_lat double, last_seen_t double")
    assert sorted((r.serial, r.why) for r in rebuild.candidates(f, 1000.0).collect()) == [("LOST", "silent"), ("MID", "mid-air")]


def changes(spark):
    row = lambda s, kind, t, alt=400.0, lat=45.0, by="timeout", top=20_000.0: (s, 0.0, kind, t, "LANDED", lat, 7.0, alt, top, by, t - 180)
    return spark.createDataFrame([
        row("plain", "LANDED", 100.0, by="telemetry"), row("refined", "LANDED", 100.0), row("refined", "REFINED", 200.0, 380.0, 45.1), row("refined", "REFINED", 300.0, 300.0, 45.2),
        row("retracted", "LANDED", 100.0), row("retracted", "RESUMED", 200.0), row("again", "LANDED", 100.0), row("again", "REFINED", 150.0, 300.0), row("again", "RESUMED", 200.0), row("again", "LANDED", 200.0, 100.0, 46.0, "telemetry"),
        row("pad", "LANDED", 100.0, 400.0, top=900.0), row("pad", "REFINED", 200.0, 300.0, top=900.0), row("up", "NEW_FLIGHT", 1.0),
    ], KIND)


def test_landing_record(spark, tmp_path):
    got = {r.serial: r for r in ledger.ledger(ledger.changes(changes(spark))).collect()}
    assert {s: r.status for s, r in got.items()} == {"plain": "landed", "refined": "landed", "retracted": "retracted", "again": "landed", "pad": "refused"}
    assert (got["plain"].landed_t, got["refined"].landed_t, got["refined"].land_lat, got["refined"].land_alt) == (100.0, -80.0, 45.2, 300.0)
    assert (got["again"].land_lat, got["again"].landed_t, got["again"].detected_by, got["retracted"].land_lat, got["pad"].land_lat) == (46.0, 200.0, "telemetry", None, None)
    whole = sorted(map(str, ledger.ledger(ledger.changes(changes(spark))).drop("opened", "refined").collect()))
    for cuts in ((150, 199), (120, 250), (0, 1)):  # in any batches, and out of order
        path = str(tmp_path / str(cuts))
        parts = [f"t > {cuts[1]}", f"t <= {cuts[0]}", f"t > {cuts[0]} and t <= {cuts[1]}"]
        for k, part in enumerate(parts + parts[:1]):
            sinks.merge_landings(changes(spark).where(part), path, k)
        assert sorted(map(str, sinks.read_table(spark, path).drop("opened", "refined").select(*ledger.ledger(ledger.changes(changes(spark))).drop("opened", "refined").columns).collect())) == whole


def occasions(spark):
    cols = "subscriber_id long, serial string, launch_t double, t double, land_lat double, land_lon double, distance_km double, what string, near boolean"
    say = lambda who, t, what, near=True, lat=45.0: (who, "A", 0.0, t, lat, 7.0, 1.0, what, near)
    return spark.createDataFrame([say(1, 10.0, "prediction"), say(1, 2000.0, "prediction", lat=45.1), say(1, 3000.0, "landing", False), say(2, 3000.0, "landing"), say(3, 3000.0, "landing", False), say(1, 3100.0, "prediction", lat=45.3),
                                  *(say(k, 3500.0, "retraction", k == 2) for k in (1, 2, 3)), say(1, 3600.0, "prediction", lat=45.3), say(3, 3600.0, "prediction"), *(say(k, 4000.0, "landing", False, 45.4) for k in (1, 2, 3))], cols)


def test_withdrawn_landings(spark):
    got = alerts.alert_lifecycle(occasions(spark))
    rows = sorted((r.subscriber_id, r.sent_t, r.alert_type) for r in got.collect())
    assert [x[1:] for x in rows if x[0] == 1] == [(10.0, "INBOUND"), (2000.0, "UPDATE"), (3000.0, "LANDED"), (3500.0, "WITHDRAWN"), (3600.0, "UPDATE"), (4000.0, "LANDED")]
    assert [x[1:] for x in rows if x[0] > 1] == [(3000.0, "LANDED"), (3500.0, "WITHDRAWN"), (3600.0, "INBOUND"), (4000.0, "LANDED")]
    stand = sorted((r.subscriber_id, r.sent_t, r.alert_type) for r in alerts.standing(got).collect())
    assert stand == [(1, 10.0, "INBOUND"), (1, 2000.0, "UPDATE"), (1, 3600.0, "UPDATE"), (1, 4000.0, "LANDED"), (3, 3600.0, "INBOUND"), (3, 4000.0, "LANDED")]


def test_alert_stream_equals_batch(spark, tmp_path):
    whole, src = occasions(spark), str(tmp_path / "in")
    for k, part in enumerate(("t < 2500", "t between 2500 and 3550", "t > 3550")):
        whole.where(part).coalesce(1).write.mode("append").parquet(f"{src}/{k}")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    got = run(streaming.alert_stream(stream), tmp_path, "out")
    assert sorted(map(str, got.select(*alerts.alert_lifecycle(whole).columns).collect())) == sorted(map(str, alerts.alert_lifecycle(whole).collect()))


def test_falling_only(spark):
    at = spark.createDataFrame([("A", 0.0, t) for t in (5.0, 10.0, 15.0, 25.0, 30.0)] + [("B", 0.0, 12.0)], "serial string, launch_t double, predicted_t double").withColumn("state", F.lit("x"))
    events = spark.createDataFrame([("A", 0.0, "BURST", 10.0, "DESCENT"), ("A", 0.0, "REVERTED", 20.0, "ASCENT"), ("A", 0.0, "BURST", 30.0, "DESCENT")], "serial string, launch_t double, kind string, t double, state string")
    assert sorted(r.predicted_t for r in alerts.falling(at.drop("state"), events).collect()) == [10.0, 15.0, 30.0]


def test_a_batch_rewrites_only_its_parts(spark, tmp_path):
    path = tmp_path / "t"
    sinks.upsert(spark.range(500).select(F.col("id").alias("k"), F.lit(1).alias("v"), F.lit("a").alias("x")), str(path), ["k"], "v", 0)
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    sinks.upsert(spark.createDataFrame([(3, 2, "b"), (3, 2, "c"), (900, 1, "d")], "k long, v int, x string"), str(path), ["k"], "v", 1)
    after = {p for p in path.rglob("*.parquet")}
    changed = {p.parent for p in set(before) ^ after}
    assert len(changed) <= 2 and sinks.read_table(spark, str(path)).count() == 501
    first = sinks.read_table(spark, str(path)).where("k = 3").first().x
    sinks.upsert(spark.createDataFrame([(3, 2, "c"), (3, 2, "b")], "k long, v int, x string"), str(path), ["k"], "v", 2)
    assert sinks.read_table(spark, str(path)).where("k = 3").first().x == first  # ties by a rule, whatever the order
    sinks.upsert(spark.createDataFrame([], "k long, v int, x string"), str(path), ["k"], "v", 3)


def test_fan_out_stopped_between_its_sinks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    row = lambda s, t, n: (s, 86_400.0 * n, t, [45.0, t])
    batch = lambda *rows: spark.createDataFrame(list(rows), "serial string, launch_t double, predicted_t double, path array<double>")
    sinks.append_predictions(batch(row("A", 1.0, 0), row("B", 2.0, 1)), path, 0)
    second = batch(row("A", 5.0, 0), row("A", 3.0, 0), row("C", 4.0, 1))
    with monkeypatch.context() as m:
        m.setattr(sinks, "upsert", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            sinks.append_predictions(second, path, 1)
    for _ in range(2):
        sinks.append_predictions(second, path, 1)
    p = spark.read.parquet(f"{path}/predictions")
    assert sorted((r.serial, r.predicted_t, str(r.launch_day)) for r in p.collect()) == [("A", 1.0, "1970-01-01"), ("A", 3.0, "1970-01-01"), ("A", 5.0, "1970-01-01"), ("B", 2.0, "1970-01-02"), ("C", 4.0, "1970-01-02")]
    assert sorted((r.serial, r.path[1]) for r in sinks.read_table(spark, f"{path}/paths").collect()) == [("A", 5.0), ("B", 2.0), ("C", 4.0)]


def test_circles_of_all_sizes_by_cells(spark):
    import math
    import random

    from driftspark.operators import geofence

    rnd = random.Random(6)
    pts = [(i, math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180)) for i in range(1500)] + [(2000, 90.0, 0.0), (2001, -90.0, 10.0), (2002, 0.0, 180.0), (2003, 0.0, -180.0), (2004, None, 1.0)]
    near = [(p[1] + rnd.uniform(-0.01, 0.01), p[2] + rnd.uniform(-0.01, 0.01), rnd.uniform(0.5, 5)) for p in pts[:40]]
    subs = near + [(rnd.uniform(-90, 90), rnd.choice([179.95, -179.95, rnd.uniform(-180, 180)]), math.exp(rnd.uniform(0, 8))) for _ in range(60)] + [(89.9, 5.0, 30.0), (-89.0, 5.0, 200.0), (10.0, 10.0, 15_000.0), (0.0, 0.0, 25_000.0), (pts[0][1], pts[0][2], 0.0), (5.0, 5.0, -1.0)]
    circles = spark.createDataFrame([(i, *s, "t", "metric", True) for i, s in enumerate(subs)], "id long, lat double, lon double, radius_km double, topic string, units string, active boolean")
    df = geofence.geofence(spark.createDataFrame(pts, "p long, land_lat double, land_lon double"), circles)
    want = {(p[0], i) for p in pts if p[1] is not None for i, s in enumerate(subs) if flights.km(s[0], s[1], p[1], p[2]) <= s[2]}
    got = [(r.p, r.id) for r in df.collect()]
    assert set(got) == want and len(got) == len(want) and len({i for _, i in want}) > 60
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    cells = geofence.circle_cells(geofence._circles(circles).where("radius_km >= 0")).groupBy("id").count().agg(F.max("count")).first()[0]
    assert cells <= 24


def test_json_round_trip(spark):
    from driftspark.operators import tables

    rows = [("A", 2, 1.5, None), ("A", 1, -0.1, 2.25e-9), ("B", 7, None, 1e300)]
    df = spark.createDataFrame(rows, "serial string, i long, u double, rho double")
    texts = tables.to_json_rows(df, ["serial"], "i")
    assert {r.serial: r.json for r in texts.collect()}["A"] == '[{"i":1,"u":-0.1,"rho":2.25E-9},{"i":2,"u":1.5,"rho":null}]'
    assert sorted(map(tuple, tables.from_json_rows(texts, "i long, u double, rho double", ["serial"]).collect())) == sorted(rows)
    bad = spark.createDataFrame([("C", "nonsense"), ("D", None), ("E", "[]")], "serial string, json string")
    assert tables.from_json_rows(bad, "i long, u double", ["serial"]).count() == 0


def test_a_log_is_read_once_across_restarts(spark, tmp_path):
    from driftspark.sources import live

    src, out, cp = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    lines = lambda a, b: "".join(f'{{"n": {i}, "é": "{"x" * (i % 50)}"}}\n' for i in range(a, b))

    def go():
        q = live.log_frames(spark, str(src), piece="512").writeStream.foreachBatch(sinks.into(sinks.append, out)).option("checkpointLocation", cp).start()
        q.processAllAvailable()
        q.stop()
        return spark.read.parquet(out)

    (src / "a.log").write_text(lines(0, 100))
    (src / "b.log").write_text(lines(100, 150) + '{"n": 150, "half')
    assert go().count() == 150
    with (src / "b.log").open("a") as f:
        f.write('": "line"}\n' + lines(151, 160))
    (src / "c.log").write_text(lines(160, 200))
    got = go()
    assert sorted(json.loads(r.value)["n"] for r in got.collect()) == list(range(200))
    assert got.select("file", "at").distinct().count() == 200 == go().count()


def test_a_stalled_stream_is_stale(spark, tmp_path):
    import time

    from driftspark.streaming import health

    now = [T0]
    watch = health.Freshness(limit_s=120, clock=lambda: now[0])
    spark.streams.addListener(watch)
    try:
        rows = flight()[:50]
        q = health.watched(frames_of(spark, files(tmp_path / "in", rows, 2))).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        for _ in range(100):  # the listener is told a little later
            if watch.frames == 50:
                break
            time.sleep(0.1)
        end = rows[-1][2]
        assert watch.status(end + 60) == {"frames": 50, "age_s": 60.0, "silent_s": end + 60 - T0, "fresh": end + 60 - T0 <= 120, "failed": None}
        now[0] = end
        watch.heard = end
        assert watch.status(end + 100)["fresh"] and not watch.status(end + 121)["fresh"]
        q.stop()
    finally:
        spark.streams.removeListener(watch)
    assert not health.Freshness().status(5.0)["fresh"]


def test_prediction_by_state(spark):
    from driftspark.operators import landing

    rows = [r for s in ("UP", "DOWN", "OVER") for r in flight(s, burst=15_000)]
    top = max(range(len(rows) // 3), key=lambda i: rows[i][5])
    n = len(rows) // 3
    known = rows[: top - 100] + rows[n : n + top + 60] + rows[2 * n :]
    folds = {s: flights.Fold(s) for s in ("UP", "DOWN", "OVER")}
    for r in known:
        folds[r[0]].frame(tuple(r[2:]))
    out = []
    for s, f in folds.items():
        row = dict(zip(flights.NAMES, f.row("ORIGIN", f.f.last[0], bins=True)))
        out.append((s, s, row["launch_t"], row["state"], "RS41", row["t"], row["lat"], row["lon"], row["alt"], row["b"], row["residual"], row["n_points"], row["ascent_rate"], None, 0.0, row["bins"]))
    kind = "origin_id string, serial string, launch_t double, state string, type string, t double, lat double, lon double, alt double, b double, residual double, n_points long, ascent_rate double, burst_timer double, ground double, "
    df = spark.createDataFrame(out, kind + flights.ROW[flights.ROW.index("bins array") :])
    got = {r.serial: r for r in landing.predict_by_state(df).collect()}
    assert set(got) == {"DOWN"} or set(got) == {"DOWN", "UP"}
    assert got["DOWN"].state == "DESCENT" and flights.km(got["DOWN"].land_lat, got["DOWN"].land_lon, *rows[2 * n - 1][3:5]) < 3

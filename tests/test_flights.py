"""Rules of the fold by scenario, its agreement with the relational forms, landings with a known end, streams equal to batch."""

import dataclasses
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.operators import alerts, descent, flights, geofence, kinematics, landing, profiles, winds
from driftspark.params import DEFAULTS
from driftspark.plans import backtest
from driftspark.streaming import flights as streaming
from driftspark.streaming import sinks

T0 = 1_780_790_400.0
FRAMES = "serial string, frame long, t double, lat double, lon double, alt double, pressure double, temp double"


def wind(alt):
    return 8 + 22 * math.exp(-(((alt - 11_000) / 7000) ** 2)), 4 + 0.0002 * alt


def flight(serial="A", burst=20_000.0, b=5.5, step=5.0, start=T0, low=200.0, stop=0.0, air=True):
    """Frames of one flight that follows the wind up at 5 m/s and down with the ballistic constant b."""
    out, t, lat, lon, alt, up = [], start, 45.0, 7.0, low, True
    while True:
        rho = flights.std_rho(alt)
        temp = max(-56.5, 15 - 0.0065 * alt)
        out.append((serial, len(out), t, lat, lon, alt, rho * 287.05 * (temp + 273.15) / 100 if air else None, temp if air else None))
        if not up and alt <= max(low, stop):
            return out
        for _ in range(int(step / 0.5)):
            u, v = wind(alt)
            rate = 5.0 if up else -b / math.sqrt(flights.std_rho(alt))
            alt = max(low, alt + rate * 0.5)
            lat += v * 0.5 / 6_371_000 * 180 / math.pi
            lon += u * 0.5 / 6_371_000 * 180 / math.pi / math.cos(math.radians(lat))
            up = up and alt < burst
        t += step


def fold(rows, p=DEFAULTS, until=None):
    f, out = flights.Fold(rows[0][0], p), []
    for r in rows:
        out += f.frame(tuple(r[2:]))
    if until is not None:
        out += f.silence(until)[0]
    return f, [dict(zip(flights.NAMES, x)) for x in out]


def kinds(rows, **how):
    return [e["kind"] for e in fold(rows, **how)[1] if e["kind"] not in ("TRACK", "ORIGIN")]


def test_full_flight():
    f, e = fold(flight())
    assert [x["kind"] for x in e if x["kind"] not in ("TRACK", "ORIGIN")] == ["NEW_FLIGHT", "BURST", "LANDED"]
    assert abs(f.f.b - 5.5) < 0.2 and abs(f.f.burst[1] - 20_000) < 50 and f.f.launch == (45.0, 7.0)


def test_floater_and_first_heard_falling():
    up = [r for r in flight()[:600] if r[5] < 15_000]
    last = up[-1]
    still = [("A", 0, last[2] + 5 * i, last[3], last[4], last[5], None, None) for i in range(1, 100)]
    assert kinds(up + still) == ["NEW_FLIGHT", "FLOAT"]
    rows = flight()
    top = max(range(len(rows)), key=lambda i: rows[i][5])
    f, e = fold(rows[top + 40 :])
    assert "BURST" in [x["kind"] for x in e] and f.f.burst is None


def test_dip_is_reverted():
    rows = [("A", i, T0 + 5 * i, 45.0, 7.0, 200.0 + 25 * i, None, None) for i in range(200)]
    dip = [("A", 0, rows[-1][2] + 5 * i, 45.0, 7.0, rows[-1][5] - 120 * i, None, None) for i in range(1, 8)]
    again = [("A", 0, dip[-1][2] + 5 * i, 45.0, 7.0, dip[-1][5] + 100 * i, None, None) for i in range(1, 40)]
    f, e = fold(rows + dip + again)
    assert [x["kind"] for x in e].count("BURST") == 1 and f.f.state == "ASCENT" and f.f.burst is None


def test_ground_pings_reuse_and_teleports():
    rows = flight()
    end = rows[-1]
    pings = [("A", 0, end[2] + 60 * i, end[3], end[4], end[5] + (400 if i % 2 else 0), None, None) for i in range(1, 20)]
    assert kinds(rows + pings) == ["NEW_FLIGHT", "BURST", "LANDED"]
    assert kinds(rows + flight(start=end[2] + 3000)) == ["NEW_FLIGHT", "BURST", "LANDED", "NEW_FLIGHT", "BURST", "LANDED"]
    far = list(rows)
    far.insert(50, ("A", 0, rows[49][2] + 2, 60.0, 7.0, rows[49][5], None, None))
    assert kinds(far) == kinds(rows)
    jump = rows[:50] + [("A", 0, r[2], r[3] + 3, *r[4:]) for r in rows[50:60]]
    f, _ = fold(jump)
    assert f.f.last[1] > 47.5  # accepted after five rejections


def test_silence():
    rows = flight()
    down = [r for r in rows if r[2] > max(rows, key=lambda x: x[5])[2]]
    cut = lambda alt: [r for r in rows if r not in down] + [r for r in down if r[5] > alt]
    low, high = cut(1500), cut(9000)
    assert kinds(low, until=low[-1][2] + 200)[-1] == "LANDED" and kinds(high, until=high[-1][2] + 200)[-1] == "BURST"
    assert kinds(high, until=high[-1][2] + 700)[-1] == "EXPIRED"
    up = rows[:100]
    assert kinds(up, until=up[-1][2] + 5000) == ["NEW_FLIGHT"] and kinds(up, until=up[-1][2] + 5500)[-1] == "EXPIRED"
    f, _ = fold(high)
    f.silence(high[-1][2] + 700)
    assert [x[2] for x in f.frame((high[-1][2] + 800, *high[-1][3:5], 8000.0, None, None))][0] == "RESUMED" and f.f.state == "DESCENT"
    f, _ = fold(low)
    f.silence(low[-1][2] + 200)
    got = [x[2] for k in range(1, 5) for x in f.frame((low[-1][2] + 200 + 10 * k, *low[-1][3:5], low[-1][5] - 200 - 60 * k, None, None))]
    assert "RESUMED" in got


def table(spark, rows):
    return spark.createDataFrame(rows, FRAMES)


def test_fold_agrees_with_relational_forms(spark):
    rows = [r for k in range(4) for r in flight(f"S{k}", burst=15_000 + 2000 * k, b=4 + k)]
    df = table(spark, rows)
    rates = kinematics.rated(df).withColumn("rho", F.lit(1.0))
    bursts = kinematics.burst_events(rates)
    e = flights.fold_frames(df)
    fb = {r.serial: (r.burst_t, round(r.burst_alt, 6)) for r in e.where("kind = 'BURST'").collect()}
    assert fb == {r.serial: (r.burst_t, round(r.burst_alt, 6)) for r in bursts.collect()}
    samples, want = [], {}
    for k in range(4):
        f, _ = fold([r for r in rows if r[0] == f"S{k}"])
        samples += [(f"S{k}", *s) for s in f.f.samples]
        want[f"S{k}"] = flights.fit(f.f.samples, *f.f.burst)
    got = descent.fit_descent(spark.createDataFrame(samples, "serial string, t double, alt double, v_obs double, rho double"), bursts).collect()
    assert len(got) == 4 and all(abs(r.b - want[r.serial][0]) < 1e-9 and r.n_points == want[r.serial][2] and abs(r.residual - want[r.serial][1]) < 1e-9 for r in got)


def test_fit_outlier_and_regime():
    line = lambda b, n, t0, top: [(t0 + i, top - 20.0 * i, b / math.sqrt(flights.std_rho(top - 20.0 * i)), flights.std_rho(top - 20.0 * i)) for i in range(n)]
    s = line(5.0, 120, 60, 18_000)
    s[40] = (*s[40][:2], 300.0, s[40][3])
    assert abs(flights.fit(s, 0, 20_000)[0] - 5.0) < 1e-6
    assert abs(flights.fit(line(8.0, 60, 60, 18_000) + line(5.0, 40, 120, 16_800), 0, 20_000)[0] - 5.0) < 1e-6
    assert flights.fit(line(5.0, 3, 60, 18_000), 0, 20_000) is None and flights.fit(line(50.0, 40, 60, 18_000), 0, 20_000)[3]


def test_refresh_cap(spark):
    rows = [("A", 3, float(i), 1.0, 0.0, None, False) for i in range(100)] + [("A", 3, 200.0 + i, 9.0, 0.0, 1.0, True) for i in range(10)]
    r = profiles.refreshed_profile(spark.createDataFrame(rows, "serial string, bin_idx long, t double, u double, v double, rho double, descending boolean")).first()
    u = 1.0
    for _ in range(10):
        u = (u * 8 + 9) / 9
    assert abs(r.u - u) < 1e-9 and r.n == 110 and r.rho == 1.0


def test_landing_of_known_flight_and_no_lookahead(spark):
    rows = flight(burst=24_000)
    df = table(spark, rows)
    truth = spark.createDataFrame([("A", rows[-1][3], rows[-1][4])], "serial string, truth_lat double, truth_lon double")
    s = backtest.backtest(df, truth, every_s=120, p=dataclasses.replace(DEFAULTS)).orderBy("predicted_t").collect()
    assert len(s) > 5 and s[-1].error_km < 0.5 and sum(x.error_km for x in s) / len(s) < 1.5
    cut = s[3].predicted_t + 1
    early = backtest.backtest(table(spark, [r for r in rows if r[2] <= cut]), truth, every_s=120).orderBy("predicted_t").collect()
    assert [(x.predicted_t, round(x.error_km, 9)) for x in early] == [(x.predicted_t, round(x.error_km, 9)) for x in s[: len(early)]]


def test_members_spread_around_the_point(spark):
    o = backtest.origins(table(spark, flight(burst=12_000)), 300)
    point = {r.origin_id: r for r in landing.predict(o).collect()}
    cloud = landing.predict(o, members=60).collect()
    assert cloud and all(geo(r, point[r.origin_id]) < 2 and r.uncertainty_radius_km >= 0.3 for r in cloud)
    exact = landing.member_landings(o, members=3, p=dataclasses.replace(DEFAULTS, bias_sigma_mps=0.0, sigma_measured_mps=0.0, b_sigma_fit=0.0)).collect()
    assert all(flights.km(r.lat, r.lon, point[r.origin_id].land_lat, point[r.origin_id].land_lon) < 0.1 for r in exact)


def geo(a, b):
    return flights.km(a.land_lat, a.land_lon, b.land_lat, b.land_lon)


def test_blend_and_bias(spark):
    bins = spark.createDataFrame([("A", i, (i + 0.5) * 150, 10.0, 0.0, 45.0, 7.0, T0, 6.0, 0.0) for i in range(20, 60)], "serial string, bin_idx long, alt double, u double, v double, lat double, lon double, t double, bmu double, bmv double")
    q = spark.createDataFrame([("A", 45.0, 7.0, 6000.0, T0, 0.0, 4.0, 0.0), ("A", 45.0, 7.0, 2500.0, T0, 0.0, 4.0, 0.0), ("A", 45.0, 7.0, 12_000.0, T0, 0.0, 4.0, 0.0), ("A", 45.0, 7.0, 6000.0, T0 + 5400, 0.0, 4.0, 0.0), ("A", 45.0, 7.0, 6000.0, T0, 0.0, None, None)], "serial string, lat double, lon double, alt double, t double, ground double, mu double, mv double")
    got = sorted((r.alt, r.t - T0, round(r.wu, 6)) for r in winds.blended_wind(q, bins).collect() if r.mu is not None)
    assert got == [(2500.0, 0, 4.0), (6000.0, 0, 10.0), (6000.0, 5400, round(4 + 6 * math.exp(-1), 6)), (12_000.0, 0, 4.0)]
    shifted = {(r.alt, r.t - T0): r.wu for r in winds.blended_wind(q.where("mu is not null"), bins, bias=True).collect()}
    assert abs(shifted[(6000.0, 0)] - 8.0) < 1e-9 and shifted[(12_000.0, 0)] == 4.0


def test_cells_and_circles_agree(spark):
    rnd = random.Random(3)
    pts = spark.createDataFrame([(i, rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(400)], "p long, land_lat double, land_lon double")
    subs = spark.createDataFrame([(i, rnd.uniform(-88, 88), rnd.choice([179.9, -179.9, 0.0, rnd.uniform(-180, 180)]), rnd.uniform(100, 1500), "t", "metric", True) for i in range(30)], "id long, lat double, lon double, radius_km double, topic string, units string, active boolean")
    key = lambda df: sorted((r.p, r.id) for r in df.select("p", "id").collect())
    assert key(geofence.geofence(pts, subs)) == key(geofence.geofence_cells(pts, subs)) != []


def test_alert_rules():
    a = alerts.Alerts()
    say = lambda t, lat: a.prediction(t, lat, 7.0, DEFAULTS)
    assert [say(0, 45.0), say(10, 45.01), say(20, 45.1), say(30, 45.3), say(700, 45.3), say(710, 45.9)] == ["INBOUND", None, "UPDATE", None, "UPDATE", None]
    assert [a.landing(), a.landing()] == ["LANDED", None]


def test_nothing_is_told_after_the_landing(spark):
    cols = "subscriber_id long, serial string, launch_t double, t double, land_lat double, land_lon double, distance_km double"
    found = spark.createDataFrame([(1, "A", 0.0, t, 45.0 + t / 1000, 7.0, 1.0) for t in (10.0, 2000.0, 4000.0)], cols)
    down = spark.createDataFrame([(1, "A", 0.0, 3000.0, 45.0, 7.0, 1.0), (2, "A", 0.0, 3000.0, 45.0, 7.0, 2.0)], cols)
    got = alerts.alert_lifecycle(alerts.with_landings(found, down)).collect()
    assert sorted((r.subscriber_id, r.sent_t, r.alert_type) for r in got) == [(1, 10.0, "INBOUND"), (1, 2000.0, "UPDATE"), (1, 3000.0, "LANDED"), (2, 3000.0, "LANDED")]


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_equals_batch(spark, tmp_path, shuffled):
    rows = [r for k in range(3) for r in flight(f"S{k}", burst=6000, step=5.0, start=T0 + 7 * k)]
    rows += [r for h in (0, 7) for r in flight("S9", burst=6000, step=5.0, start=T0 + 3600 * h)[:200]]  # silent for hours in one backlog
    rows.sort(key=lambda r: r[2])
    rnd = random.Random(1)
    sent = list(rows)
    if shuffled:  # repeated, and out of order by less than the hold
        sent = sorted(sent + sent[::5], key=lambda r: (r[2] + rnd.uniform(0, 2.5)))
    src = tmp_path / "in"
    src.mkdir()
    n = len(sent) // 4 + 1
    for i in range(0, len(sent), n):
        (src / f"{i:06d}.json").write_text("\n".join(json.dumps(dict(zip(("serial", "frame", "t", "lat", "lon", "alt", "pressure", "temp"), r))) for r in sent[i : i + n]))
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).json(str(src)).withColumn("dt", F.timestamp_seconds("t"))
    out, p = str(tmp_path / "out"), dataclasses.replace(DEFAULTS)
    q = streaming.track_stream(stream, p).writeStream.foreachBatch(sinks.into(sinks.append, out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    keep = f"kind not in ('TRACK', 'ORIGIN') and t < {max(r[2] for r in rows) - 60}"  # silence at the very end is judged by later frames
    got = sorted((r.serial, r.kind, r.t) for r in spark.read.parquet(out).where(keep).collect())
    want = sorted((r.serial, r.kind, r.t) for r in flights.fold_frames(table(spark, rows)).where(keep).collect())
    assert got == want != []


def test_stream_dedup(spark, tmp_path):
    rows = [("A", i % 5, T0 + i % 5, 1.0, 1.0, 1.0, None, None) for i in range(20)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, FRAMES).coalesce(1).write.parquet(str(src))
    s = streaming.deduplicated(spark.readStream.schema(FRAMES).parquet(str(src)).withColumn("dt", F.timestamp_seconds("t")))
    q = s.writeStream.format("memory").queryName("dedup_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedup_out").count() == 5


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda *x: spark.createDataFrame(list(x), "k string, v long")
    sinks.upsert(row(("a", 1), ("b", 1), ("a", 2)), path, ["k"], "v", 0)
    sinks.upsert(row(("b", 5), ("c", 1)), path, ["k"], "v", 1)
    sinks.upsert(row(("zzz", 9)), path, ["k"], "v", 1)  # the batch has been written
    assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == [("a", 2), ("b", 5), ("c", 1)]
    other = str(tmp_path / "u")
    sinks.insert_ignore(row(("a", 1), ("b", 1)), other, ["k"], 0)
    sinks.insert_ignore(row(("b", 7), ("c", 3)), other, ["k"], 1)
    assert sorted(map(tuple, sinks.read_table(spark, other).collect())) == [("a", 1), ("b", 1), ("c", 3)]


def test_six_modes_and_wind_by_place(spark):
    rows = flight(burst=12_000)
    df = table(spark, rows)
    truth = spark.createDataFrame([("A", rows[-1][3], rows[-1][4])], "serial string, truth_lat double, truth_lon double")
    still = lambda r: r.withColumn("mu", r.alt * 0).withColumn("mv", r.alt * 0)
    got = {r.mode: r.mean for r in backtest.ablate(df, truth, backtest.modes(still, still), every_s=300).groupBy("mode").agg({"error_km": "avg"}).toDF("mode", "mean").collect()}
    assert len(got) == 6 and got["measured-only"] < got["model-only"] and got["gfs-only"] == got["blend+refresh"]
    o = backtest.origins(df, 300)
    by_place = lambda r: r.withColumn("u", (r.lat - 45) * 0 + 1).withColumn("v", (r.at - r.t) * 0)
    east = landing.land(o, wind=by_place).collect()
    assert east and all(abs(r.land_lat - r.lat) < 1e-9 and abs((r.land_lon - r.lon) - r.sim_s * landing.DEG / math.cos(math.radians(r.lat))) < 1e-9 for r in east)


def test_fold_by_column():
    """Rows as Arrow equal those as pandas, also none at all; density is looked up from the altitude on, as interpolation over all bins gave it."""
    f = flights.Fold("S")
    frames = [(1000.0 + 10 * i, 45 + i / 900, 7.0, 50.0 * i if i <= 300 else 15_000 - 60.0 * (i - 300), *((1013.25 * math.exp(-50 * i / 7600), 5.0) if i < 200 and i % 7 else (None, None))) for i in range(420)]
    rows, _ = flights.run_through(f, ((x, 0.0, True) for x in frames))
    a, b = flights.as_table(rows).to_pylist(), flights.as_rows(rows)
    assert [r["kind"] for r in a] == list(b["kind"]) and [r["bins"] for r in a] == list(b["bins"]) and {"BURST", "ORIGIN", "TRACK"} <= set(b["kind"])
    assert flights.as_table([]).num_rows == 0 and len(flights.as_rows([])) == 0 and flights.as_rows([])["bins"].dtype == object
    known = sorted(((i + 0.5) * 150, c[2]) for i, c in f.f.bins.items() if c[2])
    for alt in range(-500, 20_000, 37):
        if known[0][0] < alt < known[-1][0]:
            want = math.exp(np.interp(alt, [k[0] for k in known], np.log([k[1] for k in known])))
        else:
            at, r = known[0] if alt <= known[0][0] else known[-1]
            want = flights.std_rho(alt) * r / flights.std_rho(at)
        assert abs(f.density(alt) / want - 1) < 1e-12
    for n in (1, 2, 5, 8):
        x = np.array([3.0, 1.0, 9.0, 4.0, 4.0, 0.5, 7.0, 2.0])[:n]
        assert flights.median(x) == np.median(x)

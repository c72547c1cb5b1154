import math

import pytest
from pyspark.sql import functions as F

from driftspark.functions import scalars as S
from driftspark.operators import kinematics
from driftspark.sources import grids, telemetry


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# How these texts must be read.
@pytest.mark.parametrize("text,want", [
    ("44.2", 44.2), ("22010", 22010.0), (" 1.5 ", 1.5), (None, None), ("", None), ("not-a-number", None), ("-9999", None), ("-9999.0", None), ("-10000", None), ("true", None), ("NaN", None), ("inf", None), ("1.5d", None),
])
def test_tolerant_number(spark, text, want):
    assert one(spark, S.to_double(F.lit(text).cast("string")))[0] == want


def test_times(spark):
    got = one(spark, *(F.unix_seconds(S.to_ts(F.lit(x))) for x in ("2026-06-07T00:00:00Z", "2026-06-07T02:00:00+02:00", "2026-06-07T00:00:00", "12:00", "junk")))
    assert len(set(got[:3])) == 1 and got[0] is not None and got[3] is None and got[4] is None


def test_geometry(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    got = one(spark, S.haversine_km(*lit(0, 0, 0, 1)), S.bearing_deg(*lit(0, 0, 0, 1)), S.compass16(F.lit(359.0)), S.wrap_lon(F.lit(190.0)), S.lon_delta(*lit(-179, 179)), S.compass16(F.lit(100.0)))
    assert abs(got[0] - 6371 * math.pi / 180) < 1e-9 and abs(got[1] - 90) < 1e-9 and got[2] == "N" and got[3] == -170 and got[4] == 2 and got[5] == "E"


def test_atmosphere(spark):
    got = one(spark, *(S.std_density(F.lit(float(h))) for h in (0, 11_000, 20_000, 32_000)), S.measured_density(F.lit(1013.25), F.lit(15.0)), S.pressure_to_alt(F.lit(22_632.0)))
    for x, want in zip(got, (1.225, 0.3639, 0.0880, 0.01322, 1.225, 11_000)):
        assert abs(x / want - 1) < 5e-3


def test_bursts_buckets_and_radius(spark):
    null = F.lit(None).cast("double")
    est = lambda *a: S.burst_estimate(*a)
    got = one(spark, est(F.lit(1000.0), F.lit(5.0), F.lit(3000.0), F.lit("RS41"), null), est(F.lit(1000.0), F.lit(5.0), F.lit(30600.0), F.lit("rs41-SGP"), null), est(F.lit(1000.0), null, null, F.lit("X"), F.lit(27000.0)), est(F.lit(36000.0), null, null, null, null),
              S.alt_bucket(F.lit(-5.0)), S.alt_bucket(F.lit(2000.0)), S.heuristic_radius_km(F.lit(3600.0), F.lit(0.5), F.lit(1.0)))
    assert tuple(got) == (16_000.0, 35_000.0, 27_000.0, 36_100.0, "20-99km", "2-5km", 4.2)


def test_conic_grid_origin(spark):
    y, x = one(spark, *S.lcc_project(F.lit(21.138123), F.lit(237.280472)))
    assert abs(x) < 1e-6 and abs(y) < 1e-6
    y, x = one(spark, *S.lcc_project(F.lit(38.5), F.lit(-97.5)))
    assert 0 < x < 3000 * 1799 and 0 < y < 3000 * 1059


def test_inventory_names(spark):
    names = ["/d/20200101/gfs/20260609/subset_ab__gfs.t06z.pgrb2.0p25.f003", "/h/20260609/hrrr.t23z.wrfprsf03.grib2", "/h/20260609/x.grib2", "/h/20260609/gfs.t06z.pgrb2.0p25.f003.idx", "/h/gfs.t06z.pgrb2.f003"]
    got = grids.grid_inventory(spark.createDataFrame([(n,) for n in names], "path string")).orderBy("fxx", "path").collect()
    assert [(r.fxx, r.valid_t - r.cycle_t, (r.cycle_t / 3600) % 24) for r in got] == [(3, 10800, 6), (3, 10800, 23)]


def test_frames_and_rejects(spark, tmp_path):
    values = [
        '{"serial":" A1 ","lat":"45.5","lon":190,"alt":1000,"datetime":"2026-06-07T00:00:00Z","frame":"7","temp":true,"batt":-9999}', '{"serial":"","lat":1,"lon":1,"alt":1,"datetime":"2026-06-07T00:00:00Z"}',
        '{"serial":"A","lat":91,"lon":1,"alt":1,"datetime":"2026-06-07T00:00:00Z"}', '{"serial":"A","lat":1,"lon":1,"alt":null,"datetime":"2026-06-07T00:00:00Z"}', '{"serial":"A","lat":1,"lon":1,"alt":1,"datetime":"soon"}', "not json",
    ]
    frames, rejects = telemetry.normalize_frames(spark.createDataFrame([(v,) for v in values], "value string"))
    f = frames.collect()
    assert len(f) == 1 and (f[0].serial, f[0].lon, f[0].frame, f[0].temp, f[0].batt) == ("A1", -170.0, 7, None, None)
    assert sorted(r.reason for r in rejects.collect()) == ["datetime", "latitude", "position", "serial", "serial"]
    (tmp_path / "S9.json").write_text('{"recovery": {"lat": 0, "lon": 0}, "frames": [%s, %s]}' % (values[0], values[0]))
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "none.json").write_text('{"recovery": {"serial": "N"}, "frames": []}')
    c = telemetry.read_corpus(spark, str(tmp_path))
    assert {(r.corpus_serial, r.truth_lat) for r in c.collect()} == {("S9", None)}
    assert telemetry.corpus_frames(telemetry.slim(c)).count() == 1


def test_corpus_round_trip(spark, tmp_path):
    """Documents written by tasks and read back; one flight from the slim table, in order, with the filter in the scan."""
    raw = spark.createDataFrame(
        [("007", f"2026-06-07T00:0{m}:00Z", str(m), "45", "9", "100", "RS41") for m in (3, 1, 2, 1)] + [("B", "soon", "1", "45", "9", "100", None), ("B", "2026-06-07T00:00:00Z", "2", "95", "9", "1", None)],
        "serial string, datetime string, frame string, lat string, lon string, alt string, type string",
    )
    found = spark.createDataFrame([("007", 45.5, 9.5), ("C", 1.0, 1.0)], "serial string, lat double, lon double")
    docs = telemetry.corpus_documents(found, raw)
    assert {r.flight for r in docs.collect()} == {"007", "B"}
    telemetry.write_corpus(docs, str(tmp_path / "docs"))
    c = telemetry.read_corpus(spark, str(tmp_path / "docs"))
    assert {(r.corpus_serial, r.truth_lat, r.truth_lon) for r in c.collect()} == {("007", 45.5, 9.5), ("B", None, None)}
    telemetry.write_slim(c, str(tmp_path / "slim"))
    one = telemetry.read_flight(spark, str(tmp_path / "slim"), "007")
    assert [(r.i, r.frame) for r in one.collect()] == [(0, 1), (1, 2), (2, 3)]
    assert "EqualTo(corpus_serial,007)" in one._jdf.queryExecution().toString()
    assert telemetry.read_flight(spark, str(tmp_path / "slim"), "B").count() == 0


def test_flights_of_one_serial_by_silence_and_reascent(spark):
    up = lambda t0, alts: [("A", float(t0 + 10 * i), float(a)) for i, a in enumerate(alts)]
    rows = up(0, [200, 900, 500, 100]) + up(1000, [700, 100, 700, 700, 700, 900]) + up(5000, [100, 50]) + up(40_000, [900, 900, 900, 900]) + [("B", 1.0, 5000.0), ("B", 2.0, 5000.0), ("B", 3.0, 5000.0)]
    frames = spark.createDataFrame(rows, "serial string, t double, alt double")
    down = spark.createDataFrame([("A", 30.0, 100.0), ("A", 5010.0, 50.0), ("C", 1.0, 1.0), ("A", None, 0.0)], "serial string, landed_t double, land_alt double")
    got = {(r.serial, r.t): r.flight for r in kinematics.assign_flights(frames, landings=down).collect()}
    # the second flight begins with the third frame in a row above; silence ends what is landed, so what follows isn't a re-ascent of it
    assert [got["A", t] for t in (30.0, 1000.0, 1030.0, 1040.0, 1050.0, 5010.0, 40_000.0, 40_030.0)] == [1, 1, 1, 2, 2, 2, 3, 3]
    assert {got["B", t] for t in (1.0, 2.0, 3.0)} == {1} and len(got) == len(rows)
    assert {r.flight for r in kinematics.assign_flights(frames).where("serial = 'A'").collect()} == {1, 2}


def test_recovered_place_is_taken_as_reported(spark, tmp_path):
    """-9990 and less means absent in telemetry, not in a report; before, such a place was lost."""
    (tmp_path / "S1.json").write_text('{"recovery": {"serial": "S1", "lat": "9990.5", "lon": "-9990.25"}, "frames": [{"serial": "S1", "lat": "-9999"}]}')
    r = telemetry.read_corpus(spark, str(tmp_path)).first()
    assert (r.truth_lat, r.truth_lon) == (9990.5, -9990.25)


# Doubles that lie just below, on and above a half of the last digit printed.
def test_numbers_are_printed_as_printf_does(spark):
    """Before, halves of the shortest decimal went up: 56.780765 is a little less than the half, and came out as 56.78077."""
    values = [(56.780765, 5), (-67.204495, 5), (44.123455, 5), (0.15, 1), (0.25, 1), (0.35, 1), (999.95, 1), (12345.65, 1), (0.5, 0), (62.5, 0), (-86.5, 0), (123456.0, 0), (-0.00000001, 5)]
    assert list(one(spark, *(S.printed(F.lit(x), n) for x, n in values))) == [f"{x:.{n}f}" for x, n in values]
    km = lambda x, units: S.fmt_dist(F.lit(x), F.lit(units))
    assert list(one(spark, km(0.25, "metric"), km(0.35, "metric"), km(100.0, "imperial"), S.fmt_alt(F.lit(62.5), F.lit("metric")), S.fmt_alt(F.lit(1000.0), F.lit("imperial")), S.printed(F.lit(None).cast("double"), 1))) == ["0.2 km", "0.3 km", "62.1 mi", "62 m", "3281 ft", None]

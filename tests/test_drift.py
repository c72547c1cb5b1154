"""Estimates by batch: the same numbers as the array functions and Spark's hash, each fold and each member made once."""

import dataclasses
import math
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.functions import scalars as S
from driftspark.operators import drift, flights, landing
from driftspark.params import DEFAULTS
from driftspark.plans import backtest
from driftspark.plans.views import view


def origins(spark):
    cell = lambda i, rho: (i, 3.0 + i % 7, i % 5 - 2.0, rho)
    rows = [
        ("a", "S1", 0.0, 100.0, 45.0, 179.9, 9000.0, 5.0, 0.3, 9, 0.0, [cell(i, 1.1 - i / 80 if i % 3 else None) for i in (40, 2, 3, 9, 10, 31)]),
        ("b", "S1", 0.0, 160.0, -10.0, 8.0, 21_000.0, 6.5, 0.1, 1, 120.0, [cell(i, None) for i in range(30, 60)]),
        ("c", "S2", 0.0, 50.0, 1.0, 2.0, 30.0, 6.0, 0.0, 1, 40.0, []),
        ("d", "S3", 0.0, 50.0, 1.0, 2.0, 33_000.0, 6.0, None, None, -200.0, None),
    ]
    return spark.createDataFrame(rows, "origin_id string, serial string, launch_t double, t double, lat double, lon double, alt double, b double, residual double, n_points long, ground double, bins array<struct<bin_idx:long,u:double,v:double,rho:double>>")


def test_batches_land_where_array_functions_do(spark):
    o = origins(spark)
    one = {r.origin_id: r for r in landing.land(o).collect()}
    other = {r.origin_id: r for r in landing.land(o, wind=lambda rows: rows, passes=1).collect()}
    assert set(one) == set(other) == set("abcd")
    for k, x in one.items():
        y, names = other[k], ("t", "alt", "b", "land_lat", "land_lon", "land_t", "sim_s", "measured")
        assert np.allclose([x[c] for c in names], [y[c] for c in names], rtol=0, atol=1e-9), (x, y)
        assert len(x.path) == len(y.path) and all(np.allclose(a, b, rtol=0, atol=1e-9) for a, b in zip(x.path, y.path))


def test_members_draw_as_spark_does(spark):
    o = spark.createDataFrame([("x|1", 3, 40), ("y|22", 1, -2)], "origin_id string, member int, k long")
    rows = o.select(F.xxhash64(F.lit(7), "origin_id").alias("h"), "member", "k", landing.normal(F.lit(7), F.col("origin_id"), F.col("member"), F.lit("b")).alias("b"), landing.normal(F.lit(7), F.col("origin_id"), F.col("member"), F.col("k"), F.lit("eu")).alias("eu")).collect()
    for r in rows:
        each = drift.hashed(np.array([r.h]).view(np.uint64), r.member)
        assert abs(drift.normal(each, "b")[0] - r.b) < 1e-12
        assert abs(drift.normal(each, np.array([r.k]).view(np.uint64), "eu")[0] - r.eu) < 1e-12


def test_cloud_is_the_members_own(spark):
    o = origins(spark)
    got = {r.origin_id: r for r in landing.with_members(o, members=9).collect()}
    for k, rows in groupby(sorted(landing.member_landings(o, members=9).collect()), key=lambda r: r.origin_id):
        rows = list(rows)
        assert [r.member for r in rows] == list(range(1, 10))
        assert abs(np.mean([r.lat for r in rows]) - got[k].mean_lat) < 1e-9 and abs(sorted(r.s for r in rows)[4] - got[k].eta_s) < 1e-9
    assert all(r.mean_lat is None for r in landing.with_members(o, members=2).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_are_folded_once(spark, small):
    frames = view(spark, small, "frames_v")
    scores = plan(backtest.backtest(frames, backtest.last_fix(frames)))
    assert scores.count("FlatMapGroupsInArrow") == 1
    members = plan(landing.predict(backtest.origins(frames, 300), members=40, p=DEFAULTS))
    assert members.count("FlatMapGroupsInArrow") == 1 and "Generate" not in members.split("FlatMapGroupsInArrow")[0]


def test_modes_of_formulas_are_one_job(spark, small, monkeypatch):
    """Formulas give what models that add columns to rows give, without a row for each layer: one fold for both refresh caps, and all modes behind it."""
    frames = view(spark, small, "frames_v")
    coarse = lambda rows: rows.withColumn("mu", 5 + F.col("alt") / 2000).withColumn("mv", F.when(F.col("alt") > 4000, F.col("at") % 7 - F.col("lat") / 10))
    fine = lambda rows: coarse(rows).withColumn("mu", F.when(F.col("alt") < 12_000, F.col("mu") + S.seam_weight(F.col("alt"), 10_000, 3000)))
    v = lambda lat, alt, t: np.where(alt > 4000, t % 7 - lat / 10, np.nan)
    coarse_f = drift.Formula(lambda lat, lon, alt, t: (5 + alt / 2000, v(lat, alt, t)))
    fine_f = drift.Formula(lambda lat, lon, alt, t: (np.where(alt < 12_000, 5 + alt / 2000 + drift.seam_weight(alt, 10_000, 3000), np.nan), v(lat, alt, t)))
    o = backtest.origins(frames, 300).persist()
    for use, rows, formula in (("model", fine, fine_f), ("blend", coarse, coarse_f), ("bias", fine, fine_f)):
        want = {r.origin_id: r for r in backtest.predicted(o, model=rows, use=use).collect()}
        got = {r.origin_id: r for r in backtest.predicted(o, model=formula, use=use).collect()}
        assert set(want) == set(got) and len(want) > 20
        for k, w in want.items():
            assert all(getattr(got[k], c) == (pytest.approx(getattr(w, c), abs=1e-9) if getattr(w, c) is not None else None) for c in ("land_lat", "land_lon", "land_t", "sim_s", "uncertainty_radius_km")), (use, k)
    how, jobs = backtest.modes(fine_f, coarse_f), []
    monkeypatch.setattr(backtest, "saved", lambda df, name: jobs.append((name, df)) or df)
    all_modes = backtest.ablate(frames, backtest.last_fix(frames), how, every_s=300)
    assert [n for n, _ in jobs] == ["scores"] and all_modes.columns[-1] == "mode"
    text = plan(landing.predict_by(backtest.origins(frames, 300, DEFAULTS, (8, 10**9)), {m: (g["p"].refresh_cap, backtest.wind_of(None, g.get("use", "measured"), g.get("model"))) for m, g in how.items()}))
    assert text.count("FlatMapGroupsInArrow") == text.count("MapInArrow") == 1 and "Join" not in text and "Generate" not in text.split("MapInArrow")[1]
    got = {(r.mode, r.serial, r.predicted_t): r for r in all_modes.collect()}
    for mode, given in how.items():
        alone = backtest.scored(backtest.predicted(backtest.origins(frames, 300, given["p"]), **given), backtest.last_fix(frames)).collect()
        assert len(alone) == sum(k[0] == mode for k in got)
        for r in alone:
            x = got[mode, r.serial, r.predicted_t]
            assert (x.land_lat, x.land_lon, x.source) == (pytest.approx(r.land_lat, abs=1e-9), pytest.approx(r.land_lon, abs=1e-9), r.source)


def test_caps_share_the_ascent():
    """Each refresh cap's rows are those of its own fold, also where a serial lands, rises again and is silent in between."""
    def course(i):
        return 60.0 * i if i < 300 else 18_000 - 90.0 * (i - 300) if i < 490 else 900.0

    frames = [((1000.0 + 10 * i + (9000 if i > 560 else 0), 45 + i / 900 + math.sin(i / 9) / 800, 7.0, course(i if i < 560 else i - 560), None, None), 0.0, True) for i in range(1100)]
    for i in range(0, 1100, 3):
        frames[i] = ((*frames[i][0][:4], 1013.25 * math.exp(-frames[i][0][3] / 7600), 5.0), 0.0, True)
    got = flights.run_with_caps(flights.Fold("S"), (8, 10**9, 1), frames)
    for cap, own, rows, ground in got:
        alone = flights.Fold("S", dataclasses.replace(DEFAULTS, refresh_cap=cap))
        want, _ = flights.run_through(alone, frames)
        assert rows == want and own.p == alone.p and own.quiet(1e6) == alone.quiet(1e6)
    assert [g[0] for g in got] == [8, 10**9, 1] and got[0][2] != got[1][2] and [r[2] for r in got[0][2]].count("NEW_FLIGHT") == 2

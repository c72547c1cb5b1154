"""Parts, files and rows that follow the size of the input."""

import glob

import pytest
from pyspark.sql import functions as F

from driftspark.operators import winds
from driftspark.operators.flights import fold_frames
from driftspark.plans.views import view
from driftspark.sources import spread, telemetry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_follow_the_files(spark, tmp_path):
    spark.range(20_000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where("id >= 0")
    assert spread.parts(df) == 1 and spread.dealt(df, "id").rdd.getNumPartitions() == df.rdd.getNumPartitions()
    n = spread.parts(df, 8192)
    assert n > 4 and spread.dealt(df, "id", part_bytes=8192).rdd.getNumPartitions() == n
    assert spread.parts(spark.range(5)) == 0


def test_frames_are_dealt_by_size(spark, small, monkeypatch):
    monkeypatch.setattr(spread.dealt, "__kwdefaults__", {"part_bytes": 8192})
    n = spread.parts(spark.read.parquet(f"{small}/lineitem.parquet"), 8192)
    text = plan(fold_frames(view(spark, small, "frames_v"), kinds=("BURST",)))
    assert n > 4 and text.count(f", {n}),") == 2, text
    assert text.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in text


def test_corpus_is_few_files(spark, tmp_path):
    docs = spark.range(40).select(F.format_string("F%d", "id").alias("flight"), F.when(F.col("id") % 4 > 0, F.lit('{"frames":[{"lat":"1"}]}')).otherwise(F.lit('{"frames":[{"la')).alias("value"))
    telemetry.write_corpus(docs.coalesce(2), str(tmp_path / "c"))
    assert len(glob.glob(f"{tmp_path}/c/**/*.parquet", recursive=True)) <= 4
    got = telemetry.read_corpus(spark, str(tmp_path / "c")).collect()
    assert sorted(r.corpus_serial for r in got) == sorted(f"F{i}" for i in range(40) if i % 4)


@pytest.mark.parametrize("most", [0, 100])
def test_columns_are_weighed_in_the_points_row(spark, most):
    axes = spark.createDataFrame([("g", 0.0, 1.0, 3, 0.0, 1.0, 3)], "file_id string, lat0 double, dlat double, ny int, lon0 double, dlon double, nx int")
    rows = [("g", 500.0, y, x, 100.0 * y + x, None if (y, x) == (0, 0) else float(y), float(x), None) for y in range(3) for x in range(3)] + [("g", 400.0, 1, 1, 7.0, 8.0, 9.0, 250.0)]
    grid = spark.createDataFrame(rows, "file_id string, level double, iy long, ix long, gh double, u double, v double, t double")
    points = spark.createDataFrame([("a", "g", 0.25, 0.5), ("b", "g", 1.0, 1.0), ("c", "g", 9.0, 0.0), ("d", "g", 0.0, 0.0)], "point_id string, file_id string, lat double, lon double")
    out = winds.column_at(points, grid, axes, broadcast_squares=most)
    got = {(r.point_id, r.level): (r.gh, r.u, r.v, r.t) for r in out.collect()}
    by_corners = winds.grid_corners(points, axes).join(grid, ["file_id", "iy", "ix"])
    mean = lambda x: (F.sum(F.col("w") * F.col(x)) / F.sum(F.when(F.col(x).isNotNull(), F.col("w")))).alias(x)
    want = {(r.point_id, r.level): tuple(r)[2:] for r in by_corners.groupBy("point_id", "level").agg(*map(mean, ("gh", "u", "v", "t"))).collect()}
    assert set(got) == set(want) and all(x == pytest.approx(y) if x is not None and y is not None else x is y for k in want for x, y in zip(got[k], want[k]))

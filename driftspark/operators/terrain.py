"""Terrain: tiles of an area, ground height at points. Cells are a long table (tile, res, row, col, elev)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.functions import scalars as S


def tiles_for_bbox(boxes: DataFrame) -> DataFrame:
    """boxes (…, min_lat, max_lat, min_lon, max_lon) to a row per one-degree tile that they touch."""
    steps = lambda a, b: F.sequence(F.floor(a), F.floor(b))
    y = boxes.withColumn("ty", F.explode(steps(F.col("min_lat"), F.col("max_lat")))).withColumn("tx", F.explode(steps(F.col("min_lon"), F.col("max_lon"))))
    return y.withColumn("tile", S.tile_name(F.col("ty").cast("double"), F.col("tx").cast("double")))


def ground_at(points: DataFrame, cells: DataFrame, fallback: float = 0.0) -> DataFrame:
    """points (point_id, lat, lon) with ground: bilinear among the four cells of the finest tile that covers the point (res: cells
    per degree, row 0 in the south), fallback where there is none."""
    res = cells.groupBy("tile").agg(F.max("res").alias("res"))
    q = points.withColumn("tile", S.tile_name(F.col("lat"), F.col("lon"))).join(res, "tile", "left")
    fy = F.greatest(F.lit(0.0), F.least((F.col("lat") - F.floor("lat")) * F.col("res") - 0.5, F.col("res") - 1.0))
    fx = F.greatest(F.lit(0.0), F.least((F.col("lon") - F.floor("lon")) * F.col("res") - 0.5, F.col("res") - 1.0))
    q = q.withColumn("fy", fy).withColumn("fx", fx)
    corner = lambda dy, dx: F.struct(
        F.least(F.floor("fy") + dy, F.col("res") - 1).cast("long").alias("row"), F.least(F.floor("fx") + dx, F.col("res") - 1).cast("long").alias("col"),
        ((F.col("fy") - F.floor("fy")) if dy else (1 - F.col("fy") + F.floor("fy"))).alias("wy"), ((F.col("fx") - F.floor("fx")) if dx else (1 - F.col("fx") + F.floor("fx"))).alias("wx"),
    )
    four = q.where("res is not null").select("point_id", "tile", "res", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("c")).select("point_id", "tile", "res", "c.*")
    w = F.col("wy") * F.col("wx")
    h = four.join(cells, ["tile", "res", "row", "col"]).where(w > 0).groupBy("point_id").agg((F.sum(w * F.col("elev")) / F.sum(w)).alias("ground"))
    return points.join(h, "point_id", "left").withColumn("ground", F.coalesce("ground", F.lit(fallback)))


def tile_arrays(cells: DataFrame) -> DataFrame:
    """cells (tile, res, row, col, elev) to one row per tile, its finest grid as an array of rows of heights; cells that are not there
    are null. A tile has at most some million cells."""
    finest = cells.join(cells.groupBy("tile").agg(F.max("res").alias("res")), ["tile", "res"])
    rows = finest.groupBy("tile", "res", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "elev"))).alias("m"))
    spread = lambda m: F.transform(F.sequence(F.lit(0).cast("long"), F.col("res").cast("long") - 1), lambda i: F.element_at(m, i))
    rows = rows.select("tile", "res", "row", spread(F.transform_keys("m", lambda k, _: k.cast("long"))).alias("line"))
    lines = rows.groupBy("tile", "res").agg(F.map_from_entries(F.collect_list(F.struct(F.col("row").cast("long"), "line"))).alias("m"))
    return lines.select("tile", "res", F.transform(F.sequence(F.lit(0).cast("long"), F.col("res").cast("long") - 1), lambda i: F.element_at("m", i)).alias("heights"))


def ground_in_tiles(points: DataFrame, tiles: DataFrame, fallback: float = 0.0) -> DataFrame:
    """points (lat, lon, …), a stream or a table, with ground as ``ground_at`` has it: one join on the tile, then the four cells are looked
    up in its array. Corners that are missing have no weight."""
    q = points.withColumn("_tile", S.tile_name(F.col("lat"), F.col("lon"))).join(tiles.select(F.col("tile").alias("_tile"), F.col("res").alias("_res"), "heights"), "_tile", "left")
    place = lambda c: F.greatest(F.lit(0.0), F.least((F.col(c) - F.floor(c)) * F.col("_res") - 0.5, F.col("_res") - 1.0))

    def corner(at, dy, dx):
        y, x = at["y"], at["x"]
        height = F.get(F.get("heights", F.least(F.floor(y) + dy, F.col("_res") - 1).cast("int")), F.least(F.floor(x) + dx, F.col("_res") - 1).cast("int"))
        weight = ((y - F.floor(y)) if dy else (1 - y + F.floor(y))) * ((x - F.floor(x)) if dx else (1 - x + F.floor(x)))
        return F.struct(F.when((weight > 0) & height.isNotNull(), weight * height).alias("h"), F.when((weight > 0) & height.isNotNull(), weight).alias("w"))

    at = F.transform(F.array(F.struct(place("lat").alias("y"), place("lon").alias("x"))), lambda a: F.array(corner(a, 0, 0), corner(a, 0, 1), corner(a, 1, 0), corner(a, 1, 1)))[0]
    total = lambda cs, f: F.aggregate(cs, F.lit(0.0), lambda s, c: s + F.coalesce(c[f], F.lit(0.0)))
    ground = F.transform(F.array(at), lambda cs: F.when(total(cs, "w") > 0, total(cs, "h") / total(cs, "w")))[0]
    return q.withColumn("ground", F.coalesce(F.when(F.col("_res").isNotNull(), ground), F.lit(fallback))).drop("_tile", "_res", "heights")

"""Landing estimates as layered drift sums: altitude layers, wind and dwell time in each, running sums down (or up) the column.

An origin's measured column is one array in its row (some hundred bins at most). Values at altitudes and the sums over layers are
worked out for the rows of an Arrow batch together (see ``drift``), so an estimate moves no rows between tasks. Where a model's wind or
terrain is joined to the layers, layers and legs are arrays in the row too, as array functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.functions import scalars as S
from driftspark.operators import drift
from driftspark.operators.drift import DEG
from driftspark.params import DEFAULTS, Params

BIN = "struct<bin_idx:bigint,u:double,v:double,rho:double>"
LEG = "array<struct<k:bigint,lo:double,hi:double,lat:double,off:double,s:double,to_lat:double,to_off:double,to_s:double>>"


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are made once a row: what reads a generator's output doesn't repeat its expression."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def with_column(origins: DataFrame, bins: DataFrame | None, keep: list) -> DataFrame:
    """origin_id, the kept columns and ``bins``, the sorted column of each origin: its own, or that of a long table
    (origin_id, bin_idx, u, v, rho)."""
    cell = lambda b: F.struct(b["bin_idx"].cast("bigint").alias("bin_idx"), b["u"].alias("u"), b["v"].alias("v"), b["rho"].alias("rho"))
    if bins is None:
        own = origins.select("origin_id", *keep, F.array_sort(F.transform("bins", cell)).alias("bins"))
    else:
        each = bins.groupBy("origin_id").agg(F.array_sort(F.collect_list(F.struct(F.col("bin_idx").cast("bigint").alias("bin_idx"), "u", "v", "rho"))).alias("bins"))
        own = origins.select("origin_id", *keep).join(each, "origin_id", "left")
    return own.withColumn("bins", F.coalesce("bins", F.array().cast(f"array<{BIN}>")))


LISTS = ("bin_idx", "u", "v", "rho")
#: The same with the bins' own places and times, which blends with a model's wind need.
PLACED = (*LISTS, "lat", "lon", "t")


def with_lists(origins: DataFrame, bins: DataFrame | None, keep: list, names: tuple = LISTS) -> DataFrame:
    """origin_id, the kept columns, and the origin's column (see ``with_column``) as a list for each of its values, in any order."""
    if bins is not None:
        each = bins.groupBy("origin_id").agg(F.collect_list(F.struct(*names)).alias("bins"))
        origins = origins.drop("bins").join(each, "origin_id", "left")
    kinds = {"bin_idx": "array<bigint>"}
    return origins.select("origin_id", *keep, *(F.col("bins")[c].cast(kinds.get(c, "array<double>")).alias(f"_{c}") for c in names))


def in_batches(df: DataFrame, adds: str, work: Callable[[dict, drift.Bins], dict], lists: bool = False) -> DataFrame:
    """df from ``with_lists`` with the columns that ``adds`` declares (they take the place of those of the same names), as ``work`` makes
    them of the numbers of some rows (by name) and their bins. The lists go, if they are not to be kept."""
    new = T._parse_datatype_string(adds)
    listed = [c for c in PLACED if f"_{c}" in df.columns]
    old = [f for f in df.schema if f.name not in new.names and (lists or f.name not in [f"_{c}" for c in listed])]
    needs = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.LongType, T.IntegerType))]

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, drift.CHUNK):
                b = whole.slice(i, drift.CHUNK)
                cells = drift.bins_of({c: b.column(f"_{c}") for c in listed})
                with np.errstate(all="ignore"):
                    made = work({n: b.column(n).to_numpy(zero_copy_only=False) if n == "drawn" else drift.numbers(b.column(n)) for n in needs}, cells)
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, from_pandas=True) for x in (made[n] for n in new.names)]
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in old), *arrays], [*(f.name for f in old), *new.names])

    return df.mapInArrow(run, T.StructType([*old, *new]))


def _places(cells: Column) -> Column:
    """For each index from the first bin on, where the last bin at or below it is."""
    width = lambda x, i: F.coalesce(F.get(cells, i + 1)["bin_idx"] - x["bin_idx"], F.lit(1)).cast("int")
    return F.flatten(F.transform(cells, lambda x, i: F.array_repeat(i, width(x, i))))


def _below(cells: Column, places: Column, j: Column) -> Column:
    """Position of the last bin whose middle is at or below that of bin j; -1: none."""
    at = j - F.get(cells, F.lit(0))["bin_idx"]
    return F.when(F.size(cells) == 0, F.lit(-1)).when(at < 0, F.lit(-1)).otherwise(F.coalesce(F.get(places, at.cast("int")), F.size(cells) - 1))


def with_layers(df: DataFrame, low: Column, high: Column, layer_m: float, down: bool, p: Params = DEFAULTS) -> DataFrame:
    """Adds ``layers`` between low and high in order of passage: k from sea level, lo, hi, mid, h, and u, v, rho at the middle:
    between bins linear (rho: log-linear), outside the column its edge (rho: the standard atmosphere scaled to it), without one
    no wind and the standard atmosphere."""
    df = bound(df, air=F.filter("bins", lambda b: b["rho"] > 0))
    df = bound(df, at_bin=_places(F.col("bins")), at_air=_places(F.col("air")))
    steps = F.when(high > low, F.sequence(F.floor(low / layer_m), F.ceil(high / layer_m) - 1)).otherwise(F.array().cast("array<bigint>"))
    lo, hi = lambda k: F.greatest(k * layer_m, low), lambda k: F.least((k + 1) * layer_m, high)
    cut = lambda k: F.struct(k.alias("k"), lo(k).alias("lo"), hi(k).alias("hi"), ((lo(k) + hi(k)) / 2).alias("mid"))

    def around(x):
        j = F.floor(x["mid"] / p.bin_m - 0.5)
        i, a = _below(F.col("bins"), F.col("at_bin"), j), _below(F.col("air"), F.col("at_air"), j)
        near = (F.get("bins", i).alias("b0"), F.get("bins", i + 1).alias("b1"), F.get("air", a).alias("a0"), F.get("air", a + 1).alias("a1"))
        return F.struct(*(x[c].alias(c) for c in ("k", "lo", "hi", "mid")), *near)

    def valued(x):
        middle = lambda b: (b["bin_idx"] + 0.5) * p.bin_m
        share = lambda lower, upper: (x["mid"] - middle(lower)) / (middle(upper) - middle(lower))
        wind = lambda c: F.coalesce(x["b0"][c] + share(x["b0"], x["b1"]) * (x["b1"][c] - x["b0"][c]), x["b0"][c], x["b1"][c], F.lit(0.0))
        edge = lambda b: S.std_density(x["mid"]) * b["rho"] / S.std_density(middle(b))
        inside = x["a0"]["rho"] * F.pow(x["a1"]["rho"] / x["a0"]["rho"], share(x["a0"], x["a1"]))
        return F.struct(
            *(x[c].alias(c) for c in ("k", "lo", "hi", "mid")), (x["hi"] - x["lo"]).alias("h"), wind("u").alias("u"), wind("v").alias("v"),
            F.coalesce(inside, edge(x["a0"]), edge(x["a1"]), S.std_density(x["mid"])).alias("rho"),
        )

    order = F.reverse(steps) if down else steps
    return bound(df.drop("layers"), layers=F.transform(F.transform(F.transform(order, cut), around), valued)).drop("air", "at_bin", "at_air")


def with_wind(df: DataFrame, wind: Callable[[DataFrame], DataFrame], legs: DataFrame | None = None) -> DataFrame:
    """Layers with u and v as ``wind`` makes them of rows (origin_id, t, ground, k, lat, lon, alt, at, u, v): at the origin's place
    and time, or, with the legs of a first pass, where and when that pass met the layer. This takes a row for each layer."""
    rows = df.select("origin_id", "t", "ground", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.explode("layers").alias("x"))
    if legs is not None:
        met = legs.select("origin_id", F.explode("legs").alias("g")).select("origin_id", F.col("g.k").alias("gk"), "g")
        rows = rows.join(met.withColumnRenamed("origin_id", "gid"), (F.col("origin_id") == F.col("gid")) & (F.col("x.k") == F.col("gk")), "left").drop("gid", "gk")
        lat, lon, at = F.coalesce("g.lat", "lat0"), S.wrap_lon(F.col("lon0") + F.coalesce("g.off", F.lit(0.0))), F.col("t") + F.coalesce("g.s", F.lit(0.0))
    else:
        lat, lon, at = F.col("lat0"), F.col("lon0"), F.col("t")
    rows = wind(rows.select("origin_id", "t", "ground", "x", F.col("x.k").alias("k"), F.col("x.mid").alias("alt"), lat.alias("lat"), lon.alias("lon"), at.alias("at"), "x.u", "x.v"))
    new = F.struct(F.col("x.k").alias("k"), "x.lo", "x.hi", "x.mid", "x.h", "u", "v", "x.rho")
    each = rows.groupBy("origin_id").agg(F.reverse(F.array_sort(F.collect_list(new))).alias("layers"))
    return df.drop("layers").join(each, "origin_id", "left").withColumn("layers", F.coalesce("layers", F.array().cast(each.schema["layers"].dataType)))


def with_legs(df: DataFrame, secs: Callable[[Column], Column]) -> DataFrame:
    """Adds ``legs``: where the payload enters and leaves each layer. Latitudes add up first, then longitudes with the cosine."""
    start = F.struct(F.col("lat").alias("lat"), F.lit(0.0).alias("off"), F.lit(0.0).alias("s"), F.array().cast(LEG).alias("legs"))

    def step(x):
        return F.struct(*(x[c].alias(c) for c in ("k", "lo", "hi")), secs(x).alias("secs"), (x["v"] * secs(x) * DEG).alias("north"), (x["u"] * secs(x) * DEG).alias("east"))

    def leave(a, x):
        to_lat, to_off, to_s = a["lat"] + x["north"], a["off"] + x["east"] / F.cos(F.radians(a["lat"] + x["north"] / 2)), a["s"] + x["secs"]
        leg = F.struct(x["k"].alias("k"), x["lo"].alias("lo"), x["hi"].alias("hi"), a["lat"].alias("lat"), a["off"].alias("off"), a["s"].alias("s"), to_lat.alias("to_lat"), to_off.alias("to_off"), to_s.alias("to_s"))
        return F.struct(to_lat.alias("lat"), to_off.alias("off"), to_s.alias("s"), F.concat(a["legs"], F.array(leg)).alias("legs"))

    return bound(df, legs=F.aggregate(F.transform("layers", step), start, leave)["legs"])


#: What a landing carries along of its origin, if it is there.
CARRIED = ("serial", "launch_t", "residual", "n_points", "mean_lat", "mean_lon", "radius_km", "eta_s")


def land(origins: DataFrame, bins: DataFrame | None = None, terrain: DataFrame | None = None, layer_m: float = 150.0, p: Params = DEFAULTS, wind: Callable[[DataFrame], DataFrame] | drift.Wind | None = None, passes: int = 2, path: bool = True) -> DataFrame:
    """origins (origin_id, t, lat, lon, alt, b, ground, bins …) to one row each: land_lat, land_lon, land_t, sim_s, measured, and path if asked for.

    The descent ends at the ground, interpolated in the layer that crosses it; an origin at or below ground lands where it is.
    ground is a column of the origins, or comes from terrain cells for layers under 9 km (it must lie above the column ground).
    wind replaces u and v of the layers (see ``with_wind``): by the origin's place, then, in later passes, by the places of the
    pass before. A ``drift.Wind``, whose model is a formula, is worked out in the batches (without terrain), so no rows are made.
    """
    keep = ["t", "lat", "lon", "alt", "b", F.coalesce("ground", F.lit(0.0)).alias("ground"), *(c for c in CARRIED if c in origins.columns)]
    if isinstance(wind, drift.Wind) and terrain is not None:
        raise ValueError("a formula's wind over terrain cells: give the wind as a function of rows")
    if terrain is None and (wind is None or isinstance(wind, drift.Wind)):
        number = [F.col(c).cast("double").alias(c) for c in ("t", "lat", "lon", "alt", "b")]
        names = LISTS if wind is None else PLACED
        return _landed(with_lists(origins, bins, [*number, keep[5].cast("double").alias("ground"), *keep[6:]], names), layer_m, path, p, wind, passes)
    df = with_layers(with_column(origins, bins, keep), F.col("ground"), F.col("alt"), layer_m, True, p)
    secs = lambda x: x["h"] / S.terminal_speed(F.col("b"), x["rho"])
    if wind is None:
        df = with_legs(df, secs)
    else:
        first = None
        for _ in range(passes):
            first = with_legs(with_wind(df, wind, first), secs)
        df = first
    if terrain is None:
        df = df.withColumn("hit", F.get(F.filter("legs", lambda g: g["lo"] <= F.col("ground")), F.lit(0))).withColumn("under", F.col("ground"))
    else:
        df = df.join(_first_below(df, terrain), "origin_id", "left").withColumn("under", F.coalesce("under", "ground"))
    hit, part = F.col("hit"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("hit.hi") - F.col("under")) / (F.col("hit.hi") - F.col("hit.lo"))))
    between = lambda c: hit[c] + part * (hit[f"to_{c}"] - hit[c])
    first_bin, last_bin = F.get("bins", F.lit(0))["bin_idx"], F.get("bins", F.size("bins") - 1)["bin_idx"]
    measured = (F.least(F.col("alt"), (last_bin + 1) * p.bin_m) - F.greatest(F.col("ground"), first_bin * p.bin_m)) / (F.col("alt") - F.col("ground"))
    here = F.array(F.struct("lat", "lon", "alt"))
    points = F.transform(F.filter("legs", lambda g: g["k"] % 3 == 0), lambda g: F.struct(g["to_lat"].alias("lat"), S.wrap_lon(F.col("lon") + g["to_off"]).alias("lon"), g["lo"].alias("alt")))
    known = F.when((F.col("alt") > F.col("ground")) & (F.size("bins") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), measured)))
    return df.select(
        "origin_id", *(c for c in CARRIED if c in origins.columns), "t", "lat", "lon", "alt", "b", F.coalesce(between("lat"), "lat").alias("land_lat"),
        S.wrap_lon(F.col("lon") + F.coalesce(between("off"), F.lit(0.0))).alias("land_lon"), (F.col("t") + F.coalesce(between("s"), F.lit(0.0))).alias("land_t"),
        F.coalesce(between("s"), F.lit(0.0)).alias("sim_s"), F.coalesce(known, F.lit(0.0)).alias("measured"), *([F.concat(here, points).alias("path")] if path else []),
    )


def _ends(o: dict, bins: drift.Bins, d: drift.Drift, p: Params) -> dict:
    lat, lon, alt, ground = o["lat"], o["lon"], o["alt"], o["ground"]
    sim_s, filled = drift.known(d.end("s"), 0.0), bins.end > bins.begin
    first, last = (bins.take("idx", np.clip(x, 0, max(len(bins.idx) - 1, 0)), filled) for x in (bins.begin, bins.end - 1))
    part = (np.minimum(alt, (last + 1) * p.bin_m) - np.maximum(ground, first * p.bin_m)) / (alt - ground)
    return {
        "land_lat": drift.known(d.end("lat"), lat), "land_lon": drift.wrap_lon(lon + drift.known(d.end("off"), 0.0)), "land_t": o["t"] + sim_s, "sim_s": sim_s,
        "measured": np.where((alt > ground) & filled, np.clip(part, 0.0, 1.0), 0.0),
    }


def _landed(df: DataFrame, layer_m: float, path: bool, p: Params, wind: drift.Wind | None, passes: int) -> DataFrame:
    """``land`` on level ground in the origins' own columns."""
    made = "land_lat double, land_lon double, land_t double, sim_s double, measured double" + (", path array<struct<lat:double,lon:double,alt:double>>" if path else "")

    def work(o: dict, bins: drift.Bins) -> dict:
        lat, lon, alt, ground = o["lat"], o["lon"], o["alt"], o["ground"]
        layers = drift.Layers(ground, alt, layer_m, True, bins, p)
        d = drift.fallen(layers, bins, o, p, wind, passes=passes)
        out = _ends(o, bins, d, p)
        if path:
            thirds = layers.there & (layers.k % 3 == 0)
            here = lambda start, points: np.concatenate([start[:, None], points], axis=1)
            on = here(np.ones(len(lat), bool), thirds)
            points = (here(lat, d.lat[:, 1:]), here(lon, drift.wrap_lon(lon[:, None] + d.off[:, 1:])), here(alt, layers.lo))
            cells = pa.StructArray.from_arrays([pa.array(x[on], from_pandas=True) for x in points], ["lat", "lon", "alt"])
            out["path"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(on.sum(axis=1))]), pa.int32()), cells)
        return out

    return in_batches(df, made, work).drop("ground")


def land_by(origins: DataFrame, ways: dict[str, tuple[int, drift.Wind | None]], layer_m: float = 150.0, p: Params = DEFAULTS, passes: int = 2) -> DataFrame:
    """``land`` by several ways at once, with a column way: each goes over the origins of its refresh_cap (a column), by its wind. An origin's
    layers and nearest bins are found once for all its ways."""
    made = "ways array<struct<way:string,land_lat:double,land_lon:double,land_t:double,sim_s:double,measured:double>>"
    by_cap: dict[int, list[str]] = {}
    for name, (cap, _) in ways.items():
        by_cap.setdefault(cap, []).append(name)

    def work(o: dict, bins: drift.Bins) -> dict:
        sizes = np.zeros(len(o["lat"]), np.int64)
        for cap, names in by_cap.items():
            sizes[o["refresh_cap"] == cap] = len(names)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat: dict[str, np.ndarray] = {"way": np.empty(starts[-1], object)}
        for cap, names in by_cap.items():
            rows = np.flatnonzero(o["refresh_cap"] == cap)
            own, cells = {c: x[rows] for c, x in o.items()}, bins.of(rows)
            layers = drift.Layers(own["ground"], own["alt"], layer_m, True, cells, p)
            nearest = drift.Nearest(layers, cells, own["ground"], p) if any(ways[n][1] is not None and ways[n][1].use != "model" for n in names) else None
            for i, name in enumerate(names):
                ends = _ends(own, cells, drift.fallen(layers, cells, own, p, ways[name][1], nearest, passes), p)
                for c, x in ends.items():
                    flat.setdefault(c, np.full(starts[-1], np.nan))[starts[rows] + i] = x
                flat["way"][starts[rows] + i] = name
        kinds = {"way": pa.string()}
        cells = pa.StructArray.from_arrays([pa.array(x, kinds.get(c, pa.float64()), from_pandas=True) for c, x in flat.items()], list(flat))
        return {"ways": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), cells)}

    numbers = [F.col(c).cast("double").alias(c) for c in ("t", "lat", "lon", "alt", "b")]
    carried = [c for c in CARRIED if c in origins.columns]
    lists = with_lists(origins, None, [*numbers, F.coalesce("ground", F.lit(0.0)).cast("double").alias("ground"), F.col("refresh_cap").cast("long").alias("refresh_cap"), *carried], PLACED)
    return in_batches(lists, made, work).select("origin_id", *carried, "t", "lat", "lon", "alt", "b", F.inline("ways"))


def _first_below(df: DataFrame, terrain: DataFrame) -> DataFrame:
    """(origin_id, hit, under): the first leg that ends below the terrain under it, or below the origin's ground."""
    from driftspark.operators.terrain import ground_at

    rows = df.select("origin_id", "ground", "lon", F.explode("legs").alias("g")).withColumn("point_id", F.concat_ws("|", "origin_id", "g.k"))
    low = rows.where("g.lo < 9000").select("point_id", F.col("g.to_lat").alias("lat"), S.wrap_lon(F.col("lon") + F.col("g.to_off")).alias("lon"))
    g = ground_at(low, terrain).select("point_id", F.col("ground").alias("under"))
    rows = rows.join(g, "point_id", "left").withColumn("under", F.greatest(F.coalesce("under", "ground"), F.col("ground")))
    crossed = rows.where(F.col("g.lo") <= F.col("under"))
    return crossed.groupBy("origin_id").agg(F.max_by(F.struct("g", "under"), "g.k").alias("x")).select("origin_id", F.col("x.g").alias("hit"), F.col("x.under").alias("under"))


def rise(origins: DataFrame, bins: DataFrame | None = None, layer_m: float = 150.0, p: Params = DEFAULTS, keep: tuple = ()) -> DataFrame:
    """origins (origin_id, t, lat, lon, alt, ascent_rate, burst …) to the point and time of the burst at constant rate, with bins
    and the kept columns."""
    df = origins.select("origin_id", *("t", "lat", "lon", "alt"), F.greatest("ascent_rate", F.lit(0.1)).alias("_rate"), "burst", *keep, *(["bins"] if bins is None else []))

    def work(o: dict, cells: drift.Bins) -> dict:
        layers = drift.Layers(o["alt"], o["burst"], layer_m, False, cells, p)
        d = drift.Drift(layers, o["lat"], layers.h / o["_rate"][:, None])
        off, s = drift.known(d.end("off"), 0.0), drift.known(d.end("s"), 0.0)
        return {"t": o["t"] + s, "lat": drift.known(d.end("lat"), o["lat"]), "lon": drift.wrap_lon(o["lon"] + off), "alt": np.fmax(o["alt"], o["burst"])}

    lists = with_lists(df, bins, ["t", "lat", "lon", "alt", "_rate", "burst", *keep])
    up = in_batches(lists.withColumns({c: F.col(c).cast("double") for c in ("t", "lat", "lon", "alt", "_rate", "burst")}), "t double, lat double, lon double, alt double", work, lists=True)
    cell = lambda x: F.struct(*(x[f"_{c}"].alias(c) for c in LISTS))
    zipped = F.array_sort(F.transform(F.arrays_zip(*(f"_{c}" for c in LISTS)), cell))
    return up.select("origin_id", *keep, F.coalesce(zipped, F.array().cast(f"array<{BIN}>")).alias("bins"), "t", "lat", "lon", "alt")


def _uniform(*what) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*what), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def normal(*what) -> Column:
    """A standard normal number from a hash, so that a task run again draws the same (Box and Muller)."""
    return F.sqrt(-2 * F.log(_uniform(*what, F.lit(1)))) * F.cos(2 * math.pi * _uniform(*what, F.lit(2)))


def member_landings(origins: DataFrame, bins: DataFrame | None = None, members: int = DEFAULTS.members, layer_m: float = 300.0, seed: int = 7, b_sigma: Column | None = None, p: Params = DEFAULTS) -> DataFrame:
    """(origin_id, member, lat, lon, s): landings under perturbed ballistic constant, wind bias and noise that is correlated over
    layers. Members are made and folded beside the origin's layers, without a shuffle; their numbers are those of ``normal``."""

    def work(o: dict, cells: drift.Bins) -> dict:
        y, x, s = _fallen(o, cells, members, layer_m, p)
        shape = pa.array(np.arange(len(y) + 1) * members, pa.int32())
        flat = [pa.array(np.tile(np.arange(1, members + 1, dtype=np.int32), len(y))), *(pa.array(v.ravel(), from_pandas=True) for v in (y, x, s))]
        return {"e": pa.ListArray.from_arrays(shape, pa.StructArray.from_arrays(flat, ["member", "lat", "lon", "s"]))}

    df = in_batches(_before_members(origins, bins, seed, b_sigma, p), "e array<struct<member:int,lat:double,lon:double,s:double>>", work)
    return df.select("origin_id", F.inline("e"))


def with_members(origins: DataFrame, bins: DataFrame | None = None, members: int = DEFAULTS.members, layer_m: float = 300.0, seed: int = 7, b_sigma: Column | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Origins with mean_lat, mean_lon, radius_km and eta_s: the mean point of their ``member_landings``, the quantile of the members'
    distance to it, the upper median of their times; null for too few members. Members are summarised where they are made, so no row
    is made for each."""
    if members < max(3, members // 4):
        return origins.withColumns({c: F.lit(None).cast("double") for c in ("mean_lat", "mean_lon", "radius_km", "eta_s")})

    def work(o: dict, cells: drift.Bins) -> dict:
        return dict(zip(("mean_lat", "mean_lon", "radius_km", "eta_s"), drift.cloud(*_fallen(o, cells, members, layer_m, p), p)))

    made = "mean_lat double, mean_lon double, radius_km double, eta_s double"
    with_bins = ["bins"] if "bins" in origins.columns else []
    slim = _before_members(origins, bins, seed, b_sigma, p, [F.struct(*(c for c in origins.columns if c != "origin_id")).alias("_origin")])
    return in_batches(slim, made, work).select("origin_id", "_origin.*", "mean_lat", "mean_lon", "radius_km", "eta_s")


def _before_members(origins: DataFrame, bins: DataFrame | None, seed: int, b_sigma: Column | None, p: Params, keep=()) -> DataFrame:
    sigma = F.coalesce(b_sigma if b_sigma is not None else F.lit(None), F.lit(p.b_sigma_fit)).cast("double").alias("b_sigma")
    drawn = F.xxhash64(F.lit(seed), F.col("origin_id")).alias("drawn")
    return with_lists(origins, bins, [*(F.col(c).cast("double").alias(c) for c in ("lat", "lon", "alt", "b")), F.coalesce("ground", F.lit(0.0)).cast("double").alias("ground"), sigma, drawn, *keep])


def _fallen(o: dict, cells: drift.Bins, members: int, layer_m: float, p: Params) -> tuple:
    layers = drift.Layers(o["ground"], o["alt"], layer_m, True, cells, p)
    return drift.members_of(layers, o["lat"], o["lon"], o["b"], o["b_sigma"], o["drawn"].astype(np.int64).view(np.uint64), members, layer_m, p)


def predict(origins: DataFrame, members: int = 0, p: Params = DEFAULTS, bins: DataFrame | None = None, wind=None, source: str = "measured") -> DataFrame:
    """Final prediction rows: the members' mean and quantile where there are members, else the point and the heuristic radius.
    wind and its name as source, if the layers' winds are not the measured column's (see ``land``); members take the column's."""
    filled = origins.withColumns({"residual": F.coalesce("residual", F.lit(0.0)), "n_points": F.coalesce("n_points", F.lit(1))})
    if members:
        sigma = F.when(F.coalesce("n_points", F.lit(1)) > 1, F.lit(p.b_sigma_fit)).otherwise(F.lit(p.b_sigma_shortcut))
        filled = with_members(filled, bins, members, b_sigma=sigma, p=p)
    point = land(filled, bins, p=p, wind=wind, path=False)
    radius = S.heuristic_radius_km(F.col("sim_s"), F.col("measured"), F.col("residual"), p)
    if members:
        radius = F.coalesce(F.greatest(F.lit(p.base_radius_km), "radius_km"), radius)
        lat, lon, eta = F.coalesce("mean_lat", "land_lat"), F.coalesce("mean_lon", "land_lon"), F.coalesce(F.col("t") + F.col("eta_s"), "land_t")
    else:
        lat, lon, eta = F.col("land_lat"), F.col("land_lon"), F.col("land_t")
    return point.select(
        "origin_id", "serial", "launch_t", F.col("t").alias("predicted_t"), lat.alias("land_lat"), lon.alias("land_lon"), eta.alias("land_t"), F.lit(source).alias("source"),
        radius.alias("uncertainty_radius_km"), F.col("alt").alias("alt_at_pred"), "sim_s",
    )


def predict_by(origins: DataFrame, ways: dict[str, tuple[int, drift.Wind | None]], p: Params = DEFAULTS) -> DataFrame:
    """``predict`` without members by several ways at once (see ``land_by``), with a column way."""
    filled = origins.withColumns({"residual": F.coalesce("residual", F.lit(0.0)), "n_points": F.coalesce("n_points", F.lit(1))})
    source = F.when(F.col("way").isin([n for n, (_, wind) in ways.items() if wind is None]), F.lit("measured")).otherwise(F.lit("gfs"))
    return land_by(filled, ways, p=p).select(
        "origin_id", "serial", "launch_t", F.col("t").alias("predicted_t"), "land_lat", "land_lon", "land_t", source.alias("source"),
        S.heuristic_radius_km(F.col("sim_s"), F.col("measured"), F.col("residual"), p).alias("uncertainty_radius_km"), F.col("alt").alias("alt_at_pred"), "sim_s", "way",
    )


def preburst(flights: DataFrame, bins: DataFrame | None = None, site: DataFrame | None = None, prior_b: DataFrame | None = None, p: Params = DEFAULTS, wind=None, source: str = "measured") -> DataFrame:
    """flights in ASCENT or FLOAT (origin_id, serial, launch_t, type, t, lat, lon, alt, ascent_rate, burst_timer, ground[, bins]) and
    their bins: up to the estimated burst, down with the family's prior or the default; only where the column ahead is known,
    by the measured bins or a model's wind."""
    f = flights.withColumn("family", S.family(F.col("type")))
    f = f.join(site.select("origin_id", "site_burst_alt"), "origin_id", "left") if site is not None else f.withColumn("site_burst_alt", F.lit(None).cast("double"))
    f = f.join(prior_b.select("family", "prior_b"), "family", "left") if prior_b is not None else f.withColumn("prior_b", F.lit(None).cast("double"))
    f = f.withColumn("burst", S.burst_estimate(F.col("alt"), F.col("ascent_rate"), F.col("burst_timer"), F.col("type"), F.col("site_burst_alt")))
    f = f.withColumn("b", F.coalesce("prior_b", F.lit(p.default_b)))
    top = rise(f, bins, p=p, keep=("serial", "launch_t", "ground", "b")).withColumn("residual", F.lit(0.0)).withColumn("n_points", F.lit(1))
    lo, hi = F.get("bins", F.lit(0))["bin_idx"] * p.bin_m, (F.get("bins", F.size("bins") - 1)["bin_idx"] + 1) * p.bin_m
    cover = (F.least(F.col("alt"), hi) - F.greatest(F.col("ground"), lo)) / (F.col("alt") - F.col("ground"))
    known = top if wind is not None else top.where((F.size("bins") > 0) & (cover >= p.preburst_min_cover))
    return predict(known, p=p, wind=wind, source=source)


def predict_by_state(flights: DataFrame, bins: DataFrame | None = None, site: DataFrame | None = None, prior_b: DataFrame | None = None, members: int = 0, p: Params = DEFAULTS, wind=None, source: str = "measured") -> DataFrame:
    """flights (origin_id, serial, launch_t, state, type, t, lat, lon, alt, b, residual, n_points, ascent_rate, burst_timer, ground[, bins]), as the fold
    knows them, to prediction rows with state: falling ones by their fitted constant, rising and floating ones by ``preburst``; landed ones, and
    falling ones without a constant yet, have none. Rows of unknown state are left out."""
    down = predict(flights.where("state = 'DESCENT' and b is not null"), members, p, bins, wind, source)
    up = preburst(flights.where("state in ('ASCENT', 'FLOAT')").drop("b", "residual", "n_points", "burst_alt"), bins, site, prior_b, p, wind, source)
    rows = down.unionByName(up.select(*down.columns))
    return rows.join(flights.select("origin_id", "state"), "origin_id")

"""Column functions of the telemetry jobs. All stay in generated JVM code; none is a UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftspark.params import DEFAULTS, Params

EARTH_KM = 6371.0
# Standard atmosphere (gas constant, sea-level temperature and pressure, gravity; base height, base
# temperature and lapse rate of each layer; top).
R_D, T0_K, P0_PA, G0 = 287.05, 288.15, 101_325.0, 9.80665
LAYERS = ((0.0, 288.15, -0.0065), (11_000.0, 216.65, 0.0), (20_000.0, 216.65, 0.001), (32_000.0, 228.65, 0.0028))
TOP_M = 47_000.0
# Burst altitudes by type, default and ceiling.
TYPE_BURST = {"RS41": 35_000.0, "RS92": 33_000.0, "DFM": 33_000.0, "M10": 30_000.0, "M20": 30_000.0, "IMET": 30_000.0}
DEFAULT_BURST, MAX_BURST = 30_000.0, 38_000.0
# Compass points and altitude buckets.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
BUCKETS = (("0-2km", 0.0, 2000.0), ("2-5km", 2000.0, 5000.0), ("5-10km", 5000.0, 10_000.0), ("10-20km", 10_000.0, 20_000.0), ("20-99km", 20_000.0, 99_000.0))


def to_number(s: Column) -> Column:
    """Tolerant number: text or JSON rendering of one; bad, boolean and non-finite give null."""
    text = F.trim(s)
    x = F.when(~text.rlike("[dDfF]$"), text.try_cast("double"))
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def to_double(s: Column) -> Column:
    """``to_number`` of a telemetry field: <= -9990 means absent."""
    x = to_number(s)
    return F.when(x > -9990.0, x)


def to_long(s: Column) -> Column:
    """Through double, truncated."""
    return to_double(s).try_cast("bigint")


def to_ts(s: Column) -> Column:
    """ISO-8601 with Z, offset or none (UTC); anything that doesn't begin with a date is null."""
    return F.when(F.trim(s).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.trim(s)))


def clean_str(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit(""))


def wrap_lon(x: Column) -> Column:
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def lon_delta(a: Column, b: Column) -> Column:
    return wrap_lon(a - b)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))), F.lit(360.0))


def compass16(bearing: Column) -> Column:
    point = F.element_at(F.array(*map(F.lit, COMPASS)), (F.floor(bearing / 22.5 + 0.5) % 16 + 1).cast("int"))
    return F.when(bearing.isNotNull(), point)


def circle_box(lat: Column, lon: Column, radius_km: Column) -> Column:
    """The box around a circle; not clamped at the poles."""
    dlat = F.degrees(radius_km / EARTH_KM)
    dlon = F.degrees(radius_km / (EARTH_KM * F.greatest(F.lit(1e-6), F.cos(F.radians(lat)))))
    return F.struct((lat - dlat).alias("min_lat"), (lat + dlat).alias("max_lat"), (lon - dlon).alias("min_lon"), (lon + dlon).alias("max_lon"))


def expand_box(box: Column, margin_km: float) -> Column:
    """The box grown by a margin and clamped to the globe."""
    dlat = math.degrees(margin_km / EARTH_KM)
    far = F.least(F.lit(89.9), F.greatest(F.abs(box["min_lat"]), F.abs(box["max_lat"])))
    dlon = F.degrees(F.lit(margin_km / EARTH_KM) / F.greatest(F.lit(1e-6), F.cos(F.radians(far))))
    return F.struct(
        F.greatest(F.lit(-90.0), box["min_lat"] - dlat).alias("min_lat"), F.least(F.lit(90.0), box["max_lat"] + dlat).alias("max_lat"),
        F.greatest(F.lit(-180.0), box["min_lon"] - dlon).alias("min_lon"), F.least(F.lit(180.0), box["max_lon"] + dlon).alias("max_lon"),
    )


def measured_density(pressure_hpa: Column, temp_c: Column) -> Column:
    kelvin = temp_c + 273.15
    return F.when((kelvin > 0) & (pressure_hpa > 0), pressure_hpa * 100.0 / (R_D * kelvin))


def _bases() -> list[tuple[float, float, float, float]]:
    """(base height, base temperature, lapse, base pressure) of each layer."""
    out, p = [], P0_PA
    for (h, t, lapse), top in zip(LAYERS, [x[0] for x in LAYERS[1:]] + [TOP_M]):
        out.append((h, t, lapse, p))
        p *= math.exp(-G0 * (top - h) / (R_D * t)) if lapse == 0 else ((t + lapse * (top - h)) / t) ** (-G0 / (R_D * lapse))
    return out


def std_density(alt: Column) -> Column:
    h = F.greatest(F.lit(0.0), F.least(alt, F.lit(TOP_M)))
    out = None
    bases = _bases()
    for k, (base, t, lapse, p) in enumerate(bases):
        temp = t + lapse * (h - base)
        pressure = p * F.exp(-G0 * (h - base) / (R_D * t)) if lapse == 0 else p * F.pow(temp / t, F.lit(-G0 / (R_D * lapse)))
        value = pressure / (R_D * temp)
        upper = bases[k + 1][0] if k + 1 < len(bases) else TOP_M
        out = F.when(h <= upper, value) if out is None else out.when(h <= upper, value)
    return out


def pressure_to_alt(pa: Column) -> Column:
    low = (T0_K / 0.0065) * (1.0 - F.pow(pa / P0_PA, F.lit(R_D * 0.0065 / G0)))
    return F.when(pa >= 22_632.0, low).otherwise(11_000.0 + (R_D * 216.65 / G0) * F.log(22_632.0 / pa))


def terminal_speed(b: Column, rho: Column) -> Column:
    return F.when(rho > 0, b * F.pow(rho, F.lit(-0.5))).otherwise(F.lit(0.0))


def heuristic_radius_km(sim_s: Column, measured: Column, residual: Column, p: Params = DEFAULTS) -> Column:
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), measured))
    rate = p.per_hour_measured_km * part + p.per_hour_extrapolated_km * (1.0 - part)
    return F.round(p.base_radius_km + F.greatest(F.lit(0.0), sim_s) / 3600.0 * rate + residual * p.residual_km_per_mps, 2)


def family(kind: Column) -> Column:
    return F.upper(F.substring_index(kind, "-", 1))


def prefix_match(kind: Column, prefix: Column) -> Column:
    return F.startswith(F.upper(kind), F.upper(prefix))


def alt_bucket(alt: Column) -> Column:
    """Name of the bucket; what is in none, negative altitudes too, counts to the last."""
    out = None
    for name, lo, hi in BUCKETS:
        inside = (alt >= lo) & (alt < hi)
        out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
    return out.otherwise(F.lit(BUCKETS[-1][0]))


def burst_estimate(alt: Column, rate: Column, timer: Column, kind: Column, site: Column) -> Column:
    """Timer and rate, else the site's past, else the type's, else the default; at least 100 m above alt."""
    timed = F.when((timer > 0) & (rate > 0) & (alt + rate * timer <= MAX_BURST), alt + rate * timer)
    by_site = F.when((site > 5000.0) & (site <= MAX_BURST), site)
    by_type = F.coalesce(*(F.when(F.upper(kind).startswith(k), F.lit(v)) for k, v in TYPE_BURST.items()))
    return F.greatest(F.coalesce(timed, by_site, by_type, F.lit(DEFAULT_BURST)), alt + 100.0)


def tile_name(lat: Column, lon: Column) -> Column:
    """Name of the one-degree terrain tile of a point."""
    y, x = F.floor(lat), F.floor(lon)
    return F.format_string("%s%02d_00_%s%03d_00", F.when(y >= 0, F.lit("N")).otherwise("S"), F.abs(y), F.when(x >= 0, F.lit("E")).otherwise("W"), F.abs(x))


def lcc_project(lat: Column, lon: Column, lat1=38.5, lat2=38.5, lad=38.5, lov=262.5, first=(21.138123, 237.280472)) -> tuple[Column, Column]:
    """Metres (y, x) from the first point of a conic grid with these parallels, origin and meridian."""
    sphere = 6_371_229.0  # fixed value: the grid's sphere
    tan = lambda deg: math.tan(math.pi / 4 + math.radians(deg) / 2)
    n = math.sin(math.radians(lat1)) if abs(lat1 - lat2) < 1e-9 else math.log(math.cos(math.radians(lat1)) / math.cos(math.radians(lat2))) / math.log(tan(lat2) / tan(lat1))
    scale = sphere * math.cos(math.radians(lat1)) * tan(lat1) ** n / n
    origin = scale / tan(lad) ** n

    def place(y, x):
        r = scale / F.pow(F.tan(math.pi / 4 + F.radians(y) / 2), F.lit(n))
        turn = n * (F.pmod(F.radians(x) - math.radians(lov) + math.pi, F.lit(2 * math.pi)) - math.pi)
        return origin - r * F.cos(turn), r * F.sin(turn)

    y, x = place(lat, lon)
    y0, x0 = place(F.lit(first[0]), F.lit(first[1]))
    return y - y0, x - x0


def axis_pos(origin: Column, step: Column, n: Column, x: Column) -> Column:
    """(lo, hi, w) of x on a regular axis; clamped at its ends."""
    f = F.greatest(F.lit(0.0), F.least((x - origin) / step, (n - 1).cast("double")))
    lo = F.least(F.floor(f), n - 1).cast("bigint")
    return F.struct(lo.alias("lo"), F.least(lo + 1, n - 1).cast("bigint").alias("hi"), (f - lo).alias("w"))


def blend_weight(dist_km: Column, age_s: Column, p: Params = DEFAULTS) -> Column:
    return F.exp(-(dist_km / p.blend_km + F.greatest(F.lit(0.0), age_s) / p.blend_age_s))


def seam_weight(alt: Column, ceiling: float, ramp: float) -> Column:
    """Weight of the fine model: 1 below the ramp, 0 from the ceiling on."""
    lo = ceiling - max(ramp, 1.0)
    return F.when(alt <= lo, F.lit(1.0)).when(alt >= ceiling, F.lit(0.0)).otherwise((ceiling - alt) / (ceiling - lo))


def printed(x: Column, digits: int) -> Column:
    """As C's printf prints a double: its exact value is rounded, halves to even. (Java's rounds the shortest decimal that stands for it, halves up, so
    a double just below a half went up.) Null stays null."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def fmt_dist(km: Column, units: Column) -> Column:
    return F.when(units == "imperial", F.concat(printed(km * 0.621371, 1), F.lit(" mi"))).otherwise(F.concat(printed(km, 1), F.lit(" km")))


def fmt_alt(m: Column, units: Column) -> Column:
    return F.when(units == "imperial", F.concat(printed(m * 3.28084, 0), F.lit(" ft"))).otherwise(F.concat(printed(m, 0), F.lit(" m")))


def dedup_key(frame: Column, dt: Column) -> Column:
    return F.coalesce(frame.cast("string"), dt.cast("string"))


def upper_median(x: Column) -> Column:
    """An aggregate: the middle of the sorted values, the upper of two."""
    ordered = F.sort_array(F.collect_list(x))
    return F.get(ordered, (F.size(ordered) / 2).cast("int"))

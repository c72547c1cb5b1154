"""Layers, drift and members of many origins at once: numpy over the rows of an Arrow batch, called by ``landing``.

Everything is a matrix of origins by layers, each origin's layers in order of passage; sums run along its own row, so an origin's
result does not depend on what else is in its batch. NaN stands for null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from driftspark.functions import scalars as S
from driftspark.params import Params

DEG = 180.0 / math.pi / (S.EARTH_KM * 1000)  # degrees of latitude a metre
#: Origins of a batch that are worked on together; their matrices then stay small.
CHUNK = 512


def numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def wrap_lon(x):
    return (x + 180.0) % 360.0 - 180.0


def known(first: np.ndarray, *others) -> np.ndarray:
    """The first that is not null."""
    for x in others:
        first = np.where(np.isnan(first), x, first)
    return first


def haversine_km(lat1, lon1, lat2, lon2):
    dlat, dlon = np.radians(lat2 - lat1) / 2, np.radians(lon2 - lon1) / 2
    a = np.sin(dlat) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(dlon) ** 2
    return 2 * S.EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def seam_weight(alt, ceiling: float, ramp: float):
    """``scalars.seam_weight``."""
    return np.clip((ceiling - alt) / max(ramp, 1.0), 0.0, 1.0)


def std_density(alt: np.ndarray) -> np.ndarray:
    h, out, upper = np.clip(alt, 0.0, S.TOP_M), None, S.TOP_M
    for base, t, lapse, p in reversed(S._bases()):
        temp = t + lapse * (h - base)
        pressure = p * np.exp(-S.G0 * (h - base) / (S.R_D * t)) if lapse == 0 else p * np.power(np.maximum(temp, 1.0) / t, -S.G0 / (S.R_D * lapse))
        value = pressure / (S.R_D * temp)
        out, upper = value if out is None else np.where(h <= upper, value, out), base
    return out


class Bins:
    """The sorted columns of all origins, one after another; ``near`` finds a bin and the next for many altitudes."""

    def __init__(self, row: np.ndarray, idx: np.ndarray, values: dict[str, np.ndarray], rows: int):
        order = np.lexsort((idx, row))
        self.row, self.idx, self.values = row[order], idx[order], {c: x[order] for c, x in values.items()}
        self.begin = np.searchsorted(self.row, np.arange(rows))
        self.end = np.searchsorted(self.row, np.arange(rows), "right")
        self.low, self.span = (self.idx.min(), self.idx.max() - self.idx.min() + 3) if len(idx) else (0, 3)
        self.key = self.row * self.span + (self.idx - self.low + 1)

    def near(self, j: np.ndarray) -> tuple:
        """For a matrix of bin numbers: places of the last bin at or below and of the one after it, and whether they are there."""
        at = np.clip(j - self.low + 1, 0, self.span - 1).astype(np.int64)
        a = np.searchsorted(self.key, np.arange(len(j))[:, None] * self.span + at, "right") - 1
        last = max(len(self.idx) - 1, 0)
        return np.clip(a, 0, last), np.clip(a + 1, 0, last), a >= self.begin[:, None], a + 1 < self.end[:, None]

    def of(self, rows: np.ndarray) -> Bins:
        """The columns of some origins (sorted places), numbered anew."""
        sizes, to = self.end[rows] - self.begin[rows], np.full(len(self.begin), -1)
        to[rows] = np.arange(len(rows))
        own = to[self.row] >= 0
        return Bins(np.repeat(np.arange(len(rows)), sizes), self.idx[own], {c: x[own] for c, x in self.values.items()}, len(rows))

    def take(self, what: str, place: np.ndarray, there: np.ndarray) -> np.ndarray:
        x = self.values[what] if what != "idx" else self.idx
        return np.where(there, x[place], np.nan) if len(x) else np.full(place.shape, np.nan)


def bins_of(lists: dict[str, pa.Array]) -> Bins:
    """lists: bin_idx, u, v, rho (and more) as arrays of lists, one list an origin."""
    sizes = np.nan_to_num(lists["bin_idx"].value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = {c: numbers(x.flatten()) for c, x in lists.items()}
    row, idx = np.repeat(np.arange(len(sizes)), sizes), flat.pop("bin_idx").astype(np.int64)
    return Bins(row, idx, flat, len(sizes))


class Layers:
    """Layers of ``layer_m`` between low and high: k from sea level, lo, hi, mid, h, and u, v, rho at the middle: between bins linear
    (rho: log-linear), outside the column its edge (rho: the standard atmosphere scaled to it), without one no wind and the standard
    atmosphere. ``n`` tells how many layers an origin has; what lies beyond has no height."""

    def __init__(self, low, high, layer_m: float, down: bool, bins: Bins, p: Params):
        air = bins.values["rho"] > 0
        air = Bins(bins.row[air], bins.idx[air], {"rho": bins.values["rho"][air]}, len(low))
        k0, k1 = np.floor(low / layer_m), np.ceil(high / layer_m) - 1
        self.n = np.where(high > low, np.nan_to_num(k1 - k0 + 1), 0).astype(np.int64)
        i = np.arange(max(self.n.max(initial=0), 1))
        self.there = i < self.n[:, None]
        self.k = np.where(self.there, k1[:, None] - i if down else k0[:, None] + i, 0.0)
        self.lo = np.where(self.there, np.maximum(self.k * layer_m, low[:, None]), 0.0)
        self.hi = np.where(self.there, np.minimum((self.k + 1) * layer_m, high[:, None]), 0.0)
        self.mid, self.h = (self.lo + self.hi) / 2, self.hi - self.lo
        j = np.floor(self.mid / p.bin_m - 0.5)
        middle = lambda idx: (idx + 0.5) * p.bin_m
        a, b, is_a, is_b = bins.near(j)
        m0, m1 = middle(bins.take("idx", a, is_a)), middle(bins.take("idx", b, is_b))
        self.around = a, b, is_a, is_b, m0, m1
        share = (self.mid - m0) / (m1 - m0)

        def wind(c):
            x0, x1 = bins.take(c, a, is_a), bins.take(c, b, is_b)
            return known(x0 + share * (x1 - x0), x0, x1, 0.0)

        self.u, self.v = wind("u"), wind("v")
        a, b, is_a, is_b = air.near(j)
        m0, m1, r0, r1 = middle(air.take("idx", a, is_a)), middle(air.take("idx", b, is_b)), air.take("rho", a, is_a), air.take("rho", b, is_b)
        self.rho = r0 * np.power(r1 / r0, (self.mid - m0) / (m1 - m0))
        out = np.isnan(self.rho)
        std = std_density(self.mid[out])
        edge = lambda r, m: std * r[out] / std_density(m[out])
        self.rho[out] = known(edge(r0, m0), edge(r1, m1), std)


def summed(start: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Running sums from start on: a column more than there are steps."""
    return np.cumsum(np.concatenate([start[:, None], steps], axis=1), axis=1)


class Drift:
    """Where (lat, off: degrees east of the origin) and when (s) layers are entered and left, at these seconds in each; latitudes add up
    first, then longitudes with the cosine. wind: u and v, if not those of the layers."""

    def __init__(self, layers: Layers, lat: np.ndarray, secs: np.ndarray, wind: tuple | None = None):
        secs = np.where(layers.there, secs, 0.0)
        u, v = wind or (layers.u, layers.v)
        north, east, nil = v * secs * DEG, u * secs * DEG, np.zeros(len(lat))
        self.n, self.lat, self.s = layers.n, summed(lat, north), summed(nil, secs)
        self.off = summed(nil, east / np.cos(np.radians(self.lat[:, :-1] + north / 2)))

    def end(self, what: str) -> np.ndarray:
        """Past the last layer; null without layers."""
        return np.where(self.n > 0, getattr(self, what)[np.arange(len(self.n)), self.n], np.nan)


def terminal_speed(b, rho):
    return b * np.power(rho, -0.5)


@dataclass(frozen=True)
class Formula:
    """A model's wind as a function of lat, lon, alt and time (arrays of one shape) to u and v (NaN: the model has none there)."""

    at: Callable

    def __call__(self, lat, lon, alt, t) -> tuple:
        return tuple(np.broadcast_to(np.asarray(x, float), alt.shape) for x in self.at(lat, lon, alt, t))


@dataclass(frozen=True)
class Wind:
    """How a model's wind and the measured column make the layers' wind; use: as in ``backtest.wind_of``."""

    model: Formula
    use: str


class Nearest:
    """The bin nearest in altitude to each layer (the lower of two), and the layers that take the model's wind ``only``: outside the
    column, near the ground and in holes. The numbers are those of ``winds.blended_wind``."""

    def __init__(self, layers: Layers, bins: Bins, ground: np.ndarray, p: Params):
        a, b, is_a, is_b, m0, m1 = layers.around
        lower = is_a & (~is_b | (layers.mid - m0 <= m1 - layers.mid))
        self.bins, self.mid, self.p = bins, layers.mid, p
        self.place, self.there = np.where(lower, a, b), np.where(lower, is_a, is_b)
        self.lat, self.lon, self.t, self.u, self.v = (bins.take(c, self.place, self.there) for c in ("lat", "lon", "t", "u", "v"))
        filled, most = bins.end > bins.begin, max(len(bins.idx) - 1, 0)
        first, last = (bins.take("idx", np.clip(x, 0, most), filled)[:, None] for x in (bins.begin, bins.end - 1))
        inside = (self.mid >= first * p.bin_m) & (self.mid < (last + 1) * p.bin_m)
        near = np.abs(np.where(lower, m0, m1) - self.mid) <= p.gap_m
        self.only = ~inside | (self.mid - ground[:, None] < p.blend_min_agl_m) | ~near

    def blended(self, layers: Layers, model: Formula, bias: bool, lat, lon, at) -> tuple:
        """u and v of layers met at these places and times; bias: the model, shifted by what was measured against it."""
        far = known(haversine_km(lat, lon, self.lat, self.lon), 0.0)
        w = np.exp(-(far / self.p.blend_km + np.maximum(0.0, known(at - self.t, 0.0)) / self.p.blend_age_s))
        told, own = model(lat, lon, self.mid, at), (None, None)
        if bias:
            cells = self.bins.values
            own = (np.where(self.there, x[self.place], np.nan) if len(x) else np.full(self.mid.shape, np.nan) for x in model(cells["lat"], cells["lon"], (self.bins.idx + 0.5) * self.p.bin_m, cells["t"]))

        def choose(measured, near, m, b):
            mixed = known(m + w * (near - b), m) if bias else w * measured + (1 - w) * m
            return np.where(np.isnan(told[0]), measured, np.where(self.only, m, mixed))

        return tuple(choose(*x) for x in zip((layers.u, layers.v), (self.u, self.v), told, own))


def fallen(layers: Layers, bins: Bins, o: dict, p: Params, wind: Wind | None = None, nearest: Nearest | None = None, passes: int = 2) -> Drift:
    """Descents of origins (t, lat, lon, b, ground) through their layers. A model's wind is taken at the origin's place and time first, then,
    in later passes, where and when the pass before met the layer."""
    secs = layers.h / terminal_speed(o["b"][:, None], layers.rho)
    if wind is None:
        return Drift(layers, o["lat"], secs)
    start = tuple(np.broadcast_to(o[c][:, None], layers.mid.shape) for c in ("lat", "lon", "t"))
    met = start
    if wind.use != "model" and nearest is None:
        nearest = Nearest(layers, bins, o["ground"], p)
    for _ in range(passes):
        if wind.use == "model":
            u, v = wind.model(met[0], met[1], layers.mid, met[2])
            by = known(u, layers.u), known(v, layers.v)
        else:
            by = nearest.blended(layers, wind.model, wind.use == "bias", *met)
        d = Drift(layers, o["lat"], secs, by)
        met = known(d.lat[:, :-1], start[0]), wrap_lon(start[1] + known(d.off[:, :-1], 0.0)), start[2] + known(d.s[:, :-1], 0.0)
    return d


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x, n: int):
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _mixed(h):
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def hashed(seed: np.ndarray, *what) -> np.ndarray:
    """``F.xxhash64`` continued from its value over the columns before: with an int, an array of longs or a short text."""
    h = seed
    for x in what:
        if isinstance(x, str):
            h = h + P5 + np.uint64(len(x))
            for c in x.encode():
                h = _rotated(h ^ (np.uint64(c) * P5), 11) * P1
        elif isinstance(x, int):
            h = _rotated((h + P5 + np.uint64(4)) ^ (np.uint64(x) * P1), 23) * P2 + P3
        else:
            h = _rotated((h + P5 + np.uint64(8)) ^ (_rotated(x * P2, 31) * P1), 27) * P1 + P4
        h = _mixed(h)
    return h


def normal(seed: np.ndarray, *what) -> np.ndarray:
    """``landing.normal`` continued from a hash."""
    uniform = lambda n: ((hashed(h, n) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
    h = hashed(seed, *what)
    return np.sqrt(-2 * np.log(uniform(1))) * np.cos(2 * math.pi * uniform(2))


def members_of(layers: Layers, lat, lon, b, b_sigma, drawn: np.ndarray, members: int, layer_m: float, p: Params) -> tuple:
    """Landings (lat, lon, s; origins by members) under a perturbed ballistic constant, wind bias and noise that is correlated over
    layers. drawn: a hash of seed and origin, as unsigned longs, from which the members' numbers follow."""
    each = np.stack([hashed(drawn, m + 1) for m in range(members)], axis=1)
    mb = b[:, None] * np.exp(b_sigma[:, None] * normal(each, "b"))
    bu, bv = p.bias_sigma_mps * normal(each, "u"), p.bias_sigma_mps * normal(each, "v")
    keep = math.exp(-layer_m / p.corr_len_m)
    fresh = math.sqrt(1 - keep * keep) * p.sigma_measured_mps
    y, x = np.repeat(lat[:, None], members, 1), np.repeat(lon[:, None], members, 1)
    s, eu, ev = (np.zeros(y.shape) for _ in range(3))
    at = layers.k.astype(np.int64).astype(np.uint64)
    for i in range(layers.k.shape[1]):
        r = np.flatnonzero(layers.there[:, i])
        if not len(r):
            break
        h = hashed(each[r], at[r, i][:, None])
        eu[r], ev[r] = keep * eu[r] + fresh * normal(h, "eu"), keep * ev[r] + fresh * normal(h, "ev")
        secs = layers.h[r, i][:, None] / terminal_speed(mb[r], layers.rho[r, i][:, None])
        x[r] += (layers.u[r, i][:, None] + bu[r] + eu[r]) * secs * DEG / np.cos(np.radians(y[r]))
        y[r] += (layers.v[r, i][:, None] + bv[r] + ev[r]) * secs * DEG
        s[r] += secs
    return y, x, s


def cloud(y: np.ndarray, x: np.ndarray, s: np.ndarray, p: Params) -> tuple:
    """Of each origin's members the mean point, the quantile of their distances to it, and the upper median of their times."""
    ref = x.min(axis=1)
    lat, lon = y.mean(axis=1), wrap_lon(ref + wrap_lon(x - ref[:, None]).mean(axis=1))
    away = haversine_km(y, x, lat[:, None], lon[:, None])
    return lat, lon, np.quantile(away, p.quantile, axis=1), np.sort(s, axis=1)[:, s.shape[1] // 2]

"""The flight fold: what depends on the frames before, one frame at a time per serial, as tables of rules.

A rule is (states it holds in, guard, action), read in order: ``ARRIVALS`` say which flight a frame belongs to (the first that fits is
taken), ``CHANGES`` what the frame does to it (each that fits is taken), ``SILENCES`` what no frame for so long means. Guards and actions
are methods of ``Fold``. ``fold_frames`` runs it over tables (groupBy serial), ``driftspark.streaming`` over streams, with the same class.
A serial's state is small: means per altitude bin, running sums of the rate window, the newest rates in order, and one descent's samples.
"""

from __future__ import annotations

import copy
import dataclasses
import math
from array import array
from bisect import bisect_left, insort
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.params import DEFAULTS, Params
from driftspark.sources.spread import dealt

ASCENT, FLOAT, DESCENT, LANDED = "ASCENT", "FLOAT", "DESCENT", "LANDED"
AIRBORNE = (ASCENT, FLOAT, DESCENT)
#: A row per event; ORIGIN rows carry what a prediction at that time may know, TRACK rows the thinned track. seen_t: time of the last frame.
ROW = (
    "serial string, launch_t double, kind string, t double, state string, lat double, lon double, alt double, vrate double, max_alt double, burst_t double, burst_alt double, "
    "b double, residual double, n_points long, launch_lat double, launch_lon double, ascent_rate double, detected_by string, seen_t double, bins array<struct<bin_idx:long,u:double,v:double,rho:double,n:long,lat:double,lon:double,t:double>>"
)
NAMES = [c.split()[0] for c in ROW.split(", bins")[0].split(", ")] + ["bins"]
BIN_NAMES = ("bin_idx", "u", "v", "rho", "n", "lat", "lon", "t")
_TYPES = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
ARROW = {c.split()[0]: _TYPES[c.split()[1]] for c in ROW.split(", bins")[0].split(", ")}
ARROW["bins"] = pa.list_(pa.struct([(c, pa.int64() if c in ("bin_idx", "n") else pa.float64()) for c in BIN_NAMES]))
EVENTS = ("NEW_FLIGHT", "BURST", "FLOAT", "LANDED", "EXPIRED", "RESUMED", "REFINED")
#: All kinds after which a flight may be in another state than before.
STATES = (*EVENTS[:-1], "REVERTED")
FRAME = ["t", "lat", "lon", "alt", "pressure", "temp"]
#: Newest positive rates that an ascent's median is of.
RATES = 600


def km(lat1, lon1, lat2, lon2) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(a)))


def std_rho(alt: float) -> float:
    """Standard density in one number; the Column form is in ``functions.scalars``."""
    from driftspark.functions.scalars import G0, LAYERS, R_D, TOP_M, _bases

    h = max(0.0, min(alt, TOP_M))
    k = max(i for i, x in enumerate(LAYERS) if h >= x[0])
    base, t, lapse, p = _bases()[k]
    temp = t + lapse * (h - base)
    return (p * math.exp(-G0 * (h - base) / (R_D * t)) if lapse == 0 else p * (temp / t) ** (-G0 / (R_D * lapse))) / (R_D * temp)


def air_density(pressure, temp) -> float | None:
    """From hPa and degrees Celsius, where both are plausible."""
    known = pressure is not None and temp is not None and pressure > 0 and temp > -273.15
    return pressure * 100 / (287.05 * (temp + 273.15)) if known else None


class Samples:
    """Descent samples (t, alt, v, rho) by column, so that a fit reads them without copying."""

    def __init__(self):
        self.columns = [array("d") for _ in range(4)]

    def append(self, *row: float) -> None:
        for c, x in zip(self.columns, row):
            c.append(x)

    def __len__(self) -> int:
        return len(self.columns[0])

    def __iter__(self):
        return zip(*self.columns)

    def matrix(self) -> np.ndarray:
        return np.array([np.frombuffer(c, float) for c in self.columns]).T


def median(x: np.ndarray) -> float:
    """``np.median`` without its checks, which take longer than the few numbers do."""
    n = len(x)
    y = np.partition(x, (n - 1) // 2) if n % 2 else np.sort(x)
    return y[n // 2] if n % 2 else (y[n // 2 - 1] + y[n // 2]) / 2


def fit(samples, burst_t, burst_alt, p: Params = DEFAULTS):
    """(b, residual, n, clamped) of descent samples (t, alt, v, rho) as far as they are known; None if too few. The relational
    form for whole flights is ``descent.fit_descent``; tests hold them against each other."""
    if not len(samples):
        return None
    t, alt, v, rho = (samples.matrix() if isinstance(samples, Samples) else np.array(samples, float)).T
    begin, top = t.min() if burst_t is None else burst_t, alt.max() if burst_alt is None else burst_alt
    settled = (t - begin >= p.transient_s) & (top - alt >= p.transient_m)
    good = settled & (v > 0) & (rho > 0)
    if min(settled.sum(), good.sum()) < p.min_fit_points:
        return None
    t, v, rho = t[good], v[good], rho[good]
    b = v * np.sqrt(rho)
    block = max(p.min_fit_points, p.regime_points)
    if len(b) >= 2 * block:  # has the constant changed? then what came before the change goes
        now, then = median(b[-block:]), median(b[:-block])
        if then > 0 and abs(now - then) > p.regime_rel * then:
            unlike = np.flatnonzero(np.abs(b[:-1] - now) > p.regime_rel / 2 * now)
            start = min(unlike[-1] + 1 if len(unlike) else 0, len(b) - block)
            t, v, rho, b = t[start:], v[start:], rho[start:], b[start:]
    away = np.abs(b - median(b))
    near = away <= 3.5 * 1.4826 * (median(away) or 1e-9)
    if near.sum() < p.min_fit_points:
        return None
    t, v, rho, b = t[near], v[near], rho[near], b[near]
    w = np.exp2((t - t.max()) / p.half_life_s)
    raw = float(w @ b / w.sum())
    one = min(max(raw, p.b_min), p.b_max)
    return one, float(np.sqrt(w @ (v - one / np.sqrt(rho)) ** 2 / w.sum())), len(b), raw != one


class Slope:
    """Least-squares slope of altitude over a window of time, by sums about the newest frame's time."""

    def __init__(self):
        self.points: deque = deque()
        self.restart()

    def restart(self) -> None:
        """Only the newest point stays."""
        last = self.points[-1] if self.points else None
        self.points.clear()
        self.base, self.sums = last[0] if last else 0.0, [0.0] * 4  # of t, alt, t * t, t * alt
        if last:
            self._sum(last, 1)
            self.points.append(last)

    def _sum(self, point, sign: int) -> None:
        t, a, s = point[0] - self.base, point[1], self.sums
        s[0] += sign * t
        s[1] += sign * a
        s[2] += sign * (t * t)
        s[3] += sign * (t * a)

    def add(self, t: float, alt: float, window: float) -> None:
        while self.points and self.points[0][0] < t - window:
            self._sum(self.points.popleft(), -1)
        if not self.points:
            self.sums = [0.0] * 4
        n, d = len(self.points), t - self.base
        st, sa, stt, sta = self.sums
        self.base, self.sums = t, [st - n * d, sa, stt - 2 * d * st + n * d * d, sta - d * sa]
        self.points.append((t, alt))
        self._sum((t, alt), 1)

    def value(self, least: int, span: float) -> float | None:
        n = len(self.points)
        if n < least or self.points[-1][0] - self.points[0][0] < span:
            return None
        st, sa, stt, sta = self.sums
        spread = stt - st * st / n
        return (sta - st * sa / n) / spread if spread > 0 else None


class Newest:
    """The newest ``keep`` numbers, also in order."""

    def __init__(self, keep: int):
        self.keep, self.queue, self.ordered = keep, deque(), []

    def add(self, x: float) -> None:
        if len(self.queue) == self.keep:
            del self.ordered[bisect_left(self.ordered, self.queue.popleft())]
        self.queue.append(x)
        insort(self.ordered, x)

    def median(self, least: int = 5) -> float | None:
        return self.ordered[len(self.ordered) // 2] if len(self.ordered) >= least else None


@dataclass
class Flight:
    launch_t: float
    first_alt: float
    launch: tuple | None = None
    state: str = ASCENT
    silenced: str | None = None  # the state that silence ended
    last: tuple | None = None  # t, lat, lon, alt, pressure, temp
    vrate: float | None = None
    max_alt: float = -1e9
    burst: tuple | None = None
    slope: Slope = field(default_factory=Slope)
    rates: Newest = field(default_factory=lambda: Newest(RATES))
    bins: dict = field(default_factory=dict)
    samples: Samples = field(default_factory=Samples)
    runs: dict = field(default_factory=dict)  # frames in a row for which something has held
    slow_since: float | None = None
    landing: tuple | None = None  # lat, lon, alt where the flight came down, as last refined
    landed_alt: float | None = None
    presumed: bool = False  # landed by silence
    b: float | None = None
    kept: tuple | None = None  # last point of the thinned track
    origin_t: float | None = None

    @property
    def ascended(self) -> float:
        return self.max_alt - self.first_alt


@dataclass
class Step:
    """A frame, the ground under it, and the segment that leads to it."""

    x: tuple
    ground: float
    seg: tuple | None = None
    rate: float | None = None

    @property
    def t(self):
        return self.x[0]

    @property
    def alt(self):
        return self.x[3]


class Fold:
    """The flight of one serial. ``frame`` and ``quiet`` return event rows. Ground is the height of the terrain, joined to the frames
    beforehand. kinds: the rows that are wanted, None: all."""

    ARRIVALS = (
        ((None,), "always", "open"),
        ((LANDED,), "silenced", "resume"),
        ((LANDED,), "climbs_again", "open"),
        ((LANDED,), "sinks_on", "reopen"),
        ((LANDED,), "lies_elsewhere", "refine"),
    )
    CHANGES = (
        ((ASCENT, FLOAT), "bursts", "fall"),
        ((ASCENT,), "hovers", "hover"),
        ((DESCENT,), "climbs_past_burst", "revert"),
        ((DESCENT,), "falls", "sample"),
        ((DESCENT,), "touches_ground", "land"),
    )
    #: (states, parameter of the wait, guard, outcome)
    SILENCES = (
        ((LANDED,), "stale_s", "always", "forget"),
        (AIRBORNE, "stale_s", "always", "expire"),
        ((ASCENT,), "ascent_silence_s", "always", "expire"),
        ((DESCENT,), "landed_silence_s", "was_low", "presume"),
        ((DESCENT,), "descent_silence_s", "always", "expire"),
    )

    def __init__(self, serial: str, p: Params = DEFAULTS, flight: Flight | None = None, kinds: frozenset | None = None):
        self.serial, self.p, self.f = serial, p, flight
        self.origins, self.track = kinds is None or "ORIGIN" in kinds, kinds is None or "TRACK" in kinds
        self.least_wait = min(getattr(p, wait) for _, wait, _, _ in self.SILENCES) + 1

    # -- rows

    def row(self, kind: str, t: float, by: str | None = None, bins: bool = False, at=None):
        f = self.f
        b, residual, n = f.b, None, None
        if kind == "ORIGIN" and f.state == DESCENT and (got := self.estimate()):
            b, residual, n = got[:3]
        cells = [(i, *c) for i, c in sorted(f.bins.items())] if bins else None
        place = at or (f.last[1:4] if f.last else (None, None, None))
        seen = f.last[0] if f.last else None
        return (self.serial, f.launch_t, kind, t, f.state, *place, f.vrate, f.max_alt, *(f.burst or (None, None)), b, residual, n, *(f.launch or (None, None)), f.rates.median(), by, seen, cells)

    def estimate(self):
        """The fit, or what the last sample says alone; (b, residual, n, clamped)."""
        f, p = self.f, self.p
        got = fit(f.samples, *(f.burst or (None, None)), p)
        if got is None and len(f.samples):
            raw = f.samples.columns[2][-1] * math.sqrt(f.samples.columns[3][-1])
            one = min(max(raw, p.b_min), p.b_max)
            got = one, 0.0, 1, raw != one
        return got

    # -- a frame

    def frame(self, x: tuple, ground: float = 0.0, inside: bool = True) -> list:
        """x: t, lat, lon, alt, pressure, temp. inside: of the capture box; outside it no flight begins, one that is known goes on."""
        if self.f is None and not inside or self.teleports(x):
            return []
        rows, step = [], Step(x, ground or 0.0)
        for states, guard, action in self.ARRIVALS:
            if (self.f.state if self.f else None) in states and getattr(self, guard)(step):
                getattr(self, action)(step, rows)
                break
        self.absorb(step)
        for states, guard, action in self.CHANGES:
            if self.f.state in states and getattr(self, guard)(step):
                getattr(self, action)(step, rows)
        self.report(step, rows)
        return rows

    def held(self, what: str, now: bool, frames: int) -> bool:
        """Whether it has been so for as many frames in a row."""
        runs = self.f.runs
        runs[what] = runs.get(what, 0) + 1 if now else 0
        return runs[what] >= frames

    def teleports(self, x) -> bool:
        """Too fast from the last frame that counted; after some such frames in a row the next counts all the same."""
        f, p = self.f, self.p
        dt = x[0] - f.last[0] if f and f.last else 0.0
        if dt <= 0:
            return False
        way = p.glitch_horizontal_mps * dt  # a degree is under 111.2 km, so most frames need no exact distance
        fast = (abs(x[1] - f.last[1]) + abs(x[2] - f.last[2])) * 111_200 > way and km(f.last[1], f.last[2], x[1], x[2]) * 1000 > way or abs(x[3] - f.last[3]) > p.glitch_vertical_mps * dt
        if self.held("teleport", fast, p.glitch_accept_after + 1):
            f.runs["teleport"] = 0
            return False
        return fast

    def absorb(self, step: Step) -> None:
        """Rate, top, rates of the ascent and the wind profile."""
        f, p, x = self.f, self.p, step.x
        step.seg = self.segment(x)
        f.slope.add(x[0], x[3], p.rate_window_s)
        slope = f.slope.value(p.rate_min_points, p.rate_min_span_s)
        step.rate = slope if slope is not None else step.seg[2] if step.seg else None
        f.max_alt = max(f.max_alt, x[3])
        if f.state == ASCENT and step.rate is not None and step.rate > 0:
            f.rates.add(step.rate)
        if f.state != LANDED:
            self.profile(step.seg, x)
        f.last = x
        if step.rate is not None:
            f.vrate = step.rate

    def segment(self, x):
        """(dt, middle altitude, climb, u, v, middle lat, lon and time) from the last frame to this one."""
        a = self.f.last
        dt = x[0] - a[0] if a else 0.0
        if dt <= 0:
            return None
        east, lat = (x[2] - a[2] + 180) % 360 - 180, (a[1] + x[1]) / 2
        metres = math.radians(1) * 6_371_000.0 / dt
        return dt, (a[3] + x[3]) / 2, (x[3] - a[3]) / dt, metres * math.cos(math.radians(lat)) * east, metres * (x[1] - a[1]), lat, (a[2] + east / 2 + 180) % 360 - 180, (a[0] + x[0]) / 2

    def profile(self, seg, x) -> None:
        """The segment joins its bin's means; in a descent a bin's past weighs as a few samples only."""
        f, p = self.f, self.p
        if seg is None or seg[0] < p.min_dt_s or math.hypot(seg[3], seg[4]) > p.max_speed_mps or abs(seg[2]) > p.max_vrate_mps:
            return
        i, rho = int(seg[1] // p.bin_m), air_density(x[4], x[5])
        if i not in f.bins:
            f.bins[i] = (seg[3], seg[4], rho, 1, *seg[5:])
            return
        u, v, dense, n, lat, lon, t = f.bins[i]
        share = 1 / ((min(n, p.refresh_cap) if f.state == DESCENT else n) + 1)
        to = lambda old, new: old + (new - old) * share
        dense = dense if rho is None else rho if dense is None else to(dense, rho)
        lon = (lon + ((seg[6] - lon + 180) % 360 - 180) * share + 180) % 360 - 180
        f.bins[i] = (to(u, seg[3]), to(v, seg[4]), dense, n + 1, to(lat, seg[5]), lon, to(t, seg[7]))

    def density(self, alt: float) -> float:
        """From the nearest bins below and above with a density, which are looked for from the altitude on; outside all, scaled to the edge."""
        bins, w = self.f.bins, self.p.bin_m
        i, low, high = math.floor(alt / w - 0.5), min(bins, default=0), max(bins, default=-1)
        a, b = min(i, high), max(i + 1, low)
        while a >= low and not (a in bins and bins[a][2]):
            a -= 1
        while b <= high and not (b in bins and bins[b][2]):
            b += 1
        if a < low or b > high:
            edge = b if a < low else a
            return std_rho(alt) * bins[edge][2] / std_rho((edge + 0.5) * w) if low <= edge <= high else std_rho(alt)
        lo, hi = math.log(bins[a][2]), math.log(bins[b][2])
        return math.exp((hi - lo) / ((b - a) * w) * (alt - (a + 0.5) * w) + lo)

    # -- which flight: guards and actions

    def always(self, step) -> bool:
        return True

    def silenced(self, step) -> bool:
        return self.f.silenced is not None

    def climbs_again(self, step) -> bool:
        return self.held("again", self.f.landed_alt is not None and step.alt > self.f.landed_alt + self.p.reascent_m, self.p.sustained_frames)

    def sinks_on(self, step) -> bool:
        return self.f.presumed and self.held("below", step.alt < self.f.landed_alt - self.p.redescent_m, self.p.sustained_frames)

    def lies_elsewhere(self, step) -> bool:
        f, p = self.f, self.p
        if not f.presumed or f.runs.get("below"):
            return False
        return km(*f.landing[:2], *step.x[1:3]) * 1000 >= p.refine_move_m or f.landing[2] - step.alt >= p.refine_alt_m

    def open(self, step, rows) -> None:
        low = step.alt <= step.ground + self.p.launch_agl_m
        self.f = Flight(step.t, step.alt, step.x[1:3] if low else None, max_alt=step.alt)
        rows.append(self.row("NEW_FLIGHT", step.t, at=step.x[1:4]))

    def resume(self, step, rows) -> None:
        self.f.state, self.f.silenced = self.f.silenced, None
        self.f.runs.clear()
        rows.append(self.row("RESUMED", step.t, at=step.x[1:4]))

    def reopen(self, step, rows) -> None:
        f = self.f
        f.state, f.presumed, f.landing, f.landed_alt, f.b = DESCENT, False, None, None, None
        f.runs.clear()
        rows.append(self.row("RESUMED", step.t, at=step.x[1:4]))

    def refine(self, step, rows) -> None:
        self.f.landing = step.x[1:4]
        rows.append(self.row("REFINED", step.t, "timeout", at=step.x[1:4]))

    # -- what a frame does: guards and actions

    def bursts(self, step) -> bool:
        f, p = self.f, self.p
        down = step.alt < f.max_alt - p.burst_drop_m and step.rate is not None and step.rate < 0
        return self.held("falling", down, p.burst_frames) and f.max_alt >= step.ground + p.airborne_agl_m

    def fall(self, step, rows) -> None:
        f = self.f
        f.state, f.slow_since = DESCENT, None
        f.burst = (step.t, f.max_alt) if f.ascended >= self.p.ascent_gain_m else None
        f.slope.restart()
        rows.append(self.row("BURST", step.t))

    def hovers(self, step) -> bool:
        f, p = self.f, self.p
        if step.alt < p.float_min_alt_m or step.rate is None or abs(step.rate) >= p.float_rate_mps:
            f.slow_since = None
        elif f.slow_since is None:
            f.slow_since = step.t
        return f.slow_since is not None and step.t > f.slow_since and step.t - f.slow_since >= p.float_window_s

    def hover(self, step, rows) -> None:
        self.f.state = FLOAT
        rows.append(self.row("FLOAT", step.t))

    def climbs_past_burst(self, step) -> bool:
        return self.f.burst is not None and step.alt > self.f.burst[1] + self.p.revert_climb_m

    def revert(self, step, rows) -> None:
        f = self.f
        f.state, f.burst, f.slow_since, f.samples = ASCENT, None, None, Samples()
        f.runs.pop("falling", None)
        rows.append(self.row("REVERTED", step.t))

    def falls(self, step) -> bool:
        return step.rate is not None and step.rate < 0

    def sample(self, step, rows) -> None:
        rho = air_density(*step.x[4:6])
        self.f.samples.append(step.t, step.alt, -step.rate, self.density(step.alt) if rho is None else rho)

    def touches_ground(self, step) -> bool:
        return self.falls(step) and step.alt <= step.ground + self.p.landed_agl_m

    def land(self, step, rows) -> None:
        self.settle()
        rows.append(self.row("LANDED", step.t, "telemetry"))

    def settle(self) -> None:
        """The flight is down where it was last heard; its constant is known if a fit or the last sample gives one in range."""
        f = self.f
        f.state, f.landing, f.landed_alt = LANDED, f.last[1:4], f.last[3]
        self.conclude()

    def conclude(self) -> None:
        if self.f.b is None and (got := self.estimate()) and not got[3]:
            self.f.b = got[0]

    def report(self, step, rows) -> None:
        """Origins of predictions at their pace, and the thinned track."""
        f, p, x = self.f, self.p, step.x
        if self.origins and f.state == DESCENT and (f.origin_t is None or x[0] - f.origin_t >= p.cadence_s or rows and rows[-1][2] == "BURST"):
            f.origin_t = x[0]
            rows.append(self.row("ORIGIN", x[0], bins=True))
        k = f.kept
        if self.track and (k is None or x[0] - k[0] >= p.track_interval_s or abs(x[3] - k[3]) >= p.track_alt_m or km(k[1], k[2], x[1], x[2]) * 1000 >= p.track_move_m):
            f.kept = x[:4]
            rows.append(self.row("TRACK", x[0]))

    # -- silence: guards and outcomes

    def was_low(self, step) -> bool:
        return step.alt <= step.ground + max(self.p.landed_agl_m, self.p.timeout_low_agl_m)

    def presume(self, now: float, rows) -> None:
        self.f.presumed = True
        self.settle()
        rows.append(self.row("LANDED", now, "timeout"))

    def expire(self, now: float, rows) -> None:
        f = self.f
        if f.state == DESCENT:
            self.conclude()
        f.silenced, f.state, f.landed_alt = f.state, LANDED, f.last[3]
        rows.append(self.row("EXPIRED", now))

    def forget(self, now: float, rows) -> None:
        self.f = None

    def silence(self, now: float, ground: float = 0.0) -> tuple[list, bool]:
        """What silence until now means, the first rule that fits; and whether the flight was forgotten."""
        rows: list = []
        if self.f is None or self.f.last is None:
            return rows, self.f is not None
        step = Step(self.f.last, ground or 0.0)
        for states, wait, guard, outcome in self.SILENCES:
            if self.f.state in states and now - self.f.last[0] > getattr(self.p, wait) and getattr(self, guard)(step):
                getattr(self, outcome)(now, rows)
                return rows, self.f is None
        return rows, False

    def waits(self) -> list[float]:
        """The times at which silence may mean something in the flight's state."""
        f = self.f
        return sorted({f.last[0] + getattr(self.p, wait) + 1 for states, wait, _, _ in self.SILENCES if f.state in states}) if f and f.last else []

    def next_silence(self, after: float = -math.inf) -> float | None:
        """When silence would next be judged, after that time."""
        return next((t for t in self.waits() if t > after), None)

    def quiet(self, until: float, ground: float | None = 0.0) -> list:
        """All that silence from the last frame until then means, judged step by step at the times when it changes something, so
        that it does not matter how late it is judged. The flight is forgotten if it has been silent for too long."""
        rows, at = [], -math.inf
        if self.f is None or self.f.last is None or until <= self.f.last[0] + self.least_wait:
            return rows
        while (t := self.next_silence(at)) is not None and t < until:
            rows += self.silence(t, ground or 0.0)[0]
            at = t
        return rows


def as_rows(rows: list) -> pd.DataFrame:
    columns = dict(zip(NAMES, zip(*rows))) if rows else dict.fromkeys(NAMES, ())
    numbers = lambda x: np.array(x, float)  # noqa: E731  (None becomes NaN)
    make = {"string": lambda x: np.array(x, object), "double": numbers, "long": lambda x: pd.array(list(x), "Int64")}
    out = {c.split()[0]: make[c.split()[1]](columns[c.split()[0]]) for c in ROW.split(", bins")[0].split(", ")}
    return pd.DataFrame(out | {"bins": pd.Series([None if r[-1] is None else [dict(zip(BIN_NAMES, c)) for c in r[-1]] for r in rows], dtype=object)})


def as_table(rows: list) -> pa.Table:
    """The same, by column: bins of all rows become eight flat columns and where each row's begin."""
    columns = list(zip(*rows)) if rows else [()] * len(NAMES)
    flat = list(zip(*(c for r in rows for c in r[-1] or ()))) or [()] * len(BIN_NAMES)
    fields = list(ARROW["bins"].value_type)
    cells = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(flat, fields)], fields=fields)
    starts, at = [], 0
    for r in rows:
        starts.append(None if r[-1] is None else at)
        at += len(r[-1] or ())
    bins = pa.ListArray.from_arrays(pa.array([*starts, at], pa.int32()), cells)
    return pa.table([*(pa.array(x, ARROW[n]) for x, n in zip(columns, NAMES[:-1])), bins], names=NAMES)


def frames_of(pdf: pd.DataFrame):
    """(frame, ground, inside) in order of time; missing pressure and temperature as None."""
    ground = pdf["ground"].fillna(0.0).tolist() if "ground" in pdf else [0.0] * len(pdf)
    inside = pdf["inside"].fillna(False).astype(bool).tolist() if "inside" in pdf else [True] * len(pdf)
    cols = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in FRAME]
    return zip(zip(*cols), ground, inside)


def play(fold: Fold, pdf: pd.DataFrame) -> tuple[list, float]:
    """The rows of all frames in order of time, silence between them judged as a stream would; and the ground under the last."""
    return run_through(fold, frames_of(pdf.sort_values("t", kind="stable")))


def run_through(fold: Fold, frames, now: float = 0.0) -> tuple[list, float]:
    rows = []
    for x, ground, inside in frames:
        rows += fold.quiet(x[0], now)
        rows += fold.frame(x, ground, inside)
        now = ground
    return rows, now


def run_with_caps(fold: Fold, caps, frames) -> list[tuple]:
    """(cap, fold, rows, ground) of ``run_through`` for each refresh cap. A cap plays a role in descents only, so up to the end of the
    frame that begins the serial's first one fold stands for all."""
    frames, rows, now = iter(frames), [], 0.0
    for f in frames:
        more, now = run_through(fold, (f,), now)
        rows += more
        if fold.f is not None and fold.f.state == DESCENT:
            break
    rest, out = list(frames), []
    for cap, own in zip(caps, [fold, *(copy.deepcopy(fold) for _ in caps[1:])]):
        own.p = dataclasses.replace(own.p, refresh_cap=cap)
        more, ground = run_through(own, rest, now)
        out.append((cap, own, rows + more, ground))
    return out


def frames_of_table(table: pa.Table):
    """``frames_of`` for a serial's frames as Arrow."""
    known = lambda c: [None if y is None or y != y else y for y in table[c].to_pylist()]
    ground = [0.0 if g is None else g for g in known("ground")] if "ground" in table.column_names else [0.0] * table.num_rows
    inside = [bool(i) for i in known("inside")] if "inside" in table.column_names else [True] * table.num_rows
    return sorted(zip(zip(*map(known, FRAME)), ground, inside), key=lambda f: (f[0][0] is None, f[0][0]))


def _slim(frames: DataFrame) -> DataFrame:
    return frames.select("serial", *FRAME, *(c for c in ("ground", "inside") if c in frames.columns))


def fold_frames(frames: DataFrame, p: Params = DEFAULTS, until: float | None = None, kinds=None, held: DataFrame | None = None, refresh_caps: tuple = ()) -> DataFrame:
    """frames (serial, t, lat, lon, alt, pressure, temp[, ground][, inside]) to event rows, of all kinds or those named: ORIGIN and TRACK
    rows are then not even made. Silence is judged between frames as a stream would, and after the last one until ``until``, if
    given; not after the last one of serials in ``held`` (serial), whose missing frames are being fetched. A serial's frames outside
    the capture box (inside false) begin no flight. With refresh_caps rows are made for each of these in place of the parameters' own, with a
    column refresh_cap. One group per serial: a serial has at most some ten thousand frames."""
    wanted = None if kinds is None else frozenset(kinds)
    rows = _slim(frames)
    if held is not None:
        rows = rows.join(held.select("serial").distinct().withColumn("held", F.lit(True)), "serial", "left")

    rows = rows.withColumns({c: F.col(c).cast("double") for c in (*FRAME, "ground") if c in rows.columns})

    def run(table: pa.Table) -> pa.Table:
        fold, out = Fold(str(table["serial"][0].as_py()), p, kinds=wanted), []
        for cap, own, rows, ground in run_with_caps(fold, refresh_caps or (p.refresh_cap,), frames_of_table(table)):
            if until is not None and not ("held" in table.column_names and table["held"][0].as_py()):
                rows += own.quiet(until, ground)
            made = as_table(rows if wanted is None else [r for r in rows if r[2] in wanted])
            out.append(made.append_column("refresh_cap", pa.array([cap] * made.num_rows, pa.int64())) if refresh_caps else made)
        return pa.concat_tables(out)

    return dealt(rows, "serial").groupBy("serial").applyInArrow(run, ROW + (", refresh_cap long" if refresh_caps else ""))

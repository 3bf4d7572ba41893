"""One vessel's ordered state as a machine: fixes in, alerts out. What the keyed streaming operator runs.

The batch plan works on whole columns; here the same rules work on one fix at a
time, so that state can be kept between micro-batches. Tests hold both to the
same alerts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pelagia import schema as S
from pelagia.operators.risk import DARK_FIRST, DARK_MORE, FISH_POINTS, SPOOF_POINTS, ZONE_POINTS

M, NM = 111_320.0, 1_852.0


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def tenth(x: float) -> float:
    return math.trunc(x * 10 + 0.5) / 10


def inside(rings: list, x: float, y: float) -> bool:
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (x - x1) * (y2 - y1) == (y - y1) * (x2 - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * ((y - y1) / (y2 - y1)) + x1:
                odd = not odd
    return odd


@dataclass(frozen=True)
class Area:
    idx: int
    id: str
    kind: str
    country: int
    rings: list

    def nm(self, lat: float, lon: float) -> float:
        if inside(self.rings, lon, lat):
            return 0.0
        scale, best = M * math.cos(math.radians(lat)), math.inf
        for ring in self.rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                ax, ay, dx, dy = (x1 - lon) * scale, (y1 - lat) * M, (x2 - x1) * scale, (y2 - y1) * M
                long = dx * dx + dy * dy
                t = max(0.0, min(1.0, (-ax * dx - ay * dy) / long)) if long else 0.0
                best = min(best, math.hypot(ax + t * dx, ay + t * dy))
        return best / NM

    def forbids(self, flag: int) -> bool:
        return self.kind == S.MPA or self.kind == S.EEZ and flag not in (0, self.country)


def areas(rows: list) -> list[Area]:
    """Of ZONE rows."""
    return [Area(z.zone_idx, z.zone_id, z.zone_kind, z.country_code, [[(p.lon, p.lat) for p in r] for r in z.rings]) for z in rows]


def least_root(a: float, b: float, c: float) -> float | None:
    if abs(a) < 1e-9:
        roots = [-c / b] if abs(b) >= 1e-9 else []
    else:
        d = b * b - 4 * a * c
        roots = [(-b - math.sqrt(d)) / (2 * a), (-b + math.sqrt(d)) / (2 * a)] if d >= 0 else []
    return min((t for t in roots if t > 1e-9), default=None)


def meet(patrol: tuple[str, float, float, float], lat: float, lon: float, kn: float, heading: float) -> tuple[str, float, float | None, bool]:
    name, p_lat, p_lon, p_kn = patrol
    px, py = (p_lon - lon) * M * math.cos(math.radians(lat)), (p_lat - lat) * M
    v, own, h = kn * NM / 3600, p_kn * NM / 3600, math.radians(heading)
    vx, vy = v * math.sin(h), v * math.cos(h)
    tau = least_root(vx * vx + vy * vy - own * own, -2 * (px * vx + py * vy), px * px + py * py)
    x, y = (vx * tau, vy * tau) if tau is not None else (0.0, 0.0)
    bearing = math.degrees(math.atan2(x - px, y - py))
    eta = tau if tau is not None else math.hypot(px, py) / own if own else None
    return name, tenth(bearing + 360 if bearing < 0 else bearing), None if eta is None else tenth(eta), tau is not None


def gear(ring: list[tuple[int, float, float]]) -> tuple[str, str] | None:
    """(kind, text) that a ring of (ts_ms, speed, heading) looks like."""
    n = len(ring)
    if n < 8:
        return None
    sp, hd = [f[1] for f in ring], [f[2] for f in ring]
    rot = 0.0
    for a, b in zip(hd, hd[1:]):
        d = b - a
        rot += d - 360 if d > 180 else d + 360 if d < -180 else d
    r = math.hypot(sum(math.sin(math.radians(h)) for h in hd) / n, sum(math.cos(math.radians(h)) for h in hd) / n)
    spread = 180.0 if r <= 0 else 0.0 if r >= 1 else math.degrees(math.sqrt(-2 * math.log(r)))
    fast, crossings = sp[0] >= 4.5, 0
    for s in sp:
        if fast and s <= 3.0 or not fast and s >= 6.0:
            fast, crossings = not fast, crossings + 1
    if n >= 10 and abs(rot) >= 270 and max(sp) > 7 and sp[0] > 5 and sp[-1] <= 2.5:
        return S.SEINING, f"{round(abs(rot))} deg net loop then stop"
    if n >= 12 and crossings >= 3 and max(sp) >= 7 and min(sp) <= 2.5 and spread < 20:
        return S.LONGLINING, f"sawtooth speed, {crossings} fast/slow cycles on a straight track"
    if n >= 12 and min(sp) >= 1 and max(sp) <= 5.5 and 2 <= sum(sp) / n <= 4.5 and spread > 25:
        return S.TRAWLING, f"slow 2.0-4.5 kn with course spread {round(spread)} deg (trawl-like)"
    return None


@dataclass
class Factors:
    """Times of the last zone entry, jump and fishing, and of recent darkness."""

    zone: int = 0
    spoof: int = 0
    fish: int = 0
    dark: list[int] = field(default_factory=list)

    def add(self, kind: str, at: int, most: int) -> None:
        if kind == S.ZONE_VIOLATION:
            self.zone = at
        elif kind == S.SPOOF:
            self.spoof = at
        elif kind == S.DARK:
            self.dark = [*self.dark, at][-most:]
        else:
            self.fish = at

    def score(self, now: int, settings: S.Settings) -> int:
        worth = lambda base, at: half_up(base * (2.0 ** (-(now - at) / settings.half_life_ms) if now > at else 1.0)) if at and now - at <= settings.window_ms else 0
        kept = [t for t in self.dark if now - t <= settings.window_ms]
        dark = worth(DARK_FIRST + DARK_MORE * (len(kept) - 1), kept[-1]) if kept else 0
        return min(100, worth(ZONE_POINTS, self.zone) + dark + worth(SPOOF_POINTS, self.spoof) + worth(FISH_POINTS, self.fish))


def tier(score: int) -> str:
    return "CRITICAL" if score >= 85 else "HIGH" if score >= 65 else "ELEVATED" if score >= 40 else "LOW"


@dataclass
class Vessel:
    """State of one vessel. ``fix``: lat, lon, ts_ms, speed, heading, flag, zone indices of the last fix."""

    fix: tuple | None = None
    ring: list[tuple[int, float, float]] = field(default_factory=list)
    last_fishing: int = 0
    told_dark: bool = False
    now: Factors = field(default_factory=Factors)
    was: Factors | None = None
    sweep: int = 0


class Machine:
    """The rules over a vessel's state."""

    def __init__(self, zones: list[Area], patrols: list[tuple[str, float, float, float]], settings: S.Settings = S.Settings()) -> None:
        self.zones, self.patrols, self.settings = zones, patrols, settings
        self.of_interest = [z for z in zones if z.kind != S.EEZ] or zones

    def threshold_s(self, speed: float) -> float:
        s = self.settings
        usual = 10.0 if speed <= 14 else 6.0 if speed <= 23 else 2.0
        return max(usual * s.silence_mult, s.min_silence_s) * s.playback_speed

    def detect_ms(self, v: Vessel) -> int | None:
        """When the last fix, if nothing follows, is dark; None if it can't be."""
        if v.fix is None or v.told_dark or v.fix[3] <= self.settings.dark_min_speed_kn:
            return None
        return v.fix[2] + math.ceil(self.threshold_s(v.fix[3]) * 1000)

    def _raise(self, v: Vessel, kind: str, at: int, ts: int, lat: float, lon: float, **more) -> list[dict]:
        out = self.sweep(v, at)
        tick = -(-at // self.settings.sweep_ms) * self.settings.sweep_ms
        if tick != v.sweep:
            v.was = Factors(v.now.zone, v.now.spoof, v.now.fish, v.now.dark) if v.now != Factors() else None
            v.sweep = tick
        v.now.add(kind, at, self.settings.max_dark)
        score = v.now.score(at, self.settings)
        severity = "CRITICAL" if score >= 85 else "MEDIUM" if kind in S.FISHING_KINDS else "HIGH"
        return [*out, {"kind": kind, "severity": severity, "at_ms": at, "ts_ms": ts, "lat": lat, "lon": lon, "score": score} | more]

    def sweep(self, v: Vessel, upto: int) -> list[dict]:
        """The tier alert of the pending sweep, if it lies before ``upto`` and the tier rose."""
        if not v.sweep or upto <= v.sweep:
            return []
        at, v.sweep = v.sweep, 0
        score = v.now.score(at, self.settings)
        before = v.was.score(at - self.settings.sweep_ms, self.settings) if v.was else 0
        if score < 65 or before >= 65:
            return []
        lat, lon = (v.fix[0], v.fix[1]) if v.fix else (0.0, 0.0)
        return [{"kind": S.SUSPECTED, "severity": "HIGH", "at_ms": at, "ts_ms": at, "lat": lat, "lon": lon, "score": score, "tier": tier(score)}]

    def darkness(self, v: Vessel, until: int) -> list[dict]:
        """The dark event of the last fix if it is silent beyond its threshold at ``until``."""
        due = self.detect_ms(v)
        if due is None:
            return []
        lat, lon, ts, speed, heading, *_ = v.fix
        silence = self.threshold_s(speed)
        if not (until - ts) / 1000.0 > silence:
            return []
        v.told_dark = True
        nm, _, name = min((z.nm(lat, lon), z.idx, z.id) for z in self.of_interest)
        if nm > self.settings.dark_near_nm:
            return []
        mps = speed * NM / 3600
        reach, h = mps * silence, math.radians(heading)
        p_lat, p_lon = lat + reach * math.cos(h) / M, lon + reach * math.sin(h) / (M * math.cos(math.radians(lat)))
        met = [meet(p, p_lat, p_lon, speed, heading) for p in self.patrols]
        return self._raise(
            v, S.DARK, due, ts, lat, lon, zone_id=name, silence_s=tenth(silence),
            cone=(lat, lon, heading, self.settings.cone_spread_deg, tenth(self.settings.cone_r0_m + 0.1 * mps * silence)), intercepts=met,
        )

    def step(self, v: Vessel, lat: float, lon: float, ts: int, speed: float, heading: float, flag: int) -> list[dict]:
        """The alerts that a fix raises, those of the silence before it first."""
        out = self.darkness(v, ts)
        out += self.sweep(v, ts)
        here = [z for z in self.zones if inside(z.rings, lon, lat)]
        before = v.fix
        if before is not None and before[2] != 0:
            v.ring = [*v.ring, (before[2], before[3], before[4])][-self.settings.history :]
        found: list[tuple[str, dict]] = []
        if before is not None:
            found += [(S.ZONE_VIOLATION, {"zone_id": z.id, "zone_kind": z.kind}) for z in here if z.idx not in before[6] and z.forbids(flag)]
            if before[2] != 0 and ts >= before[2]:
                d = math.hypot((lat - before[0]) * M, (lon - before[1]) * M * math.cos(math.radians((before[0] + lat) / 2)))
                dt = ts - before[2]
                kn = d * 3600 / NM / (dt / 1000) if dt > 0 else 9999.0
                if dt <= 60_000 and d > 50 * NM or dt >= 3_000 and kn > 60:
                    found.append((S.SPOOF, {"implied_speed_kn": half_up(kn * 10) / 10}))
            like = gear(v.ring) if any(z.forbids(flag) for z in here) else None
            if like and ts - v.last_fishing > self.settings.debounce_ms:
                found.append((like[0], {"pattern": like[1]}))
                v.last_fishing = ts
        v.fix, v.told_dark = (lat, lon, ts, speed, heading, flag, [z.idx for z in here]), False
        for kind, more in found:
            out += self._raise(v, kind, ts, ts, lat, lon, **more)
        return out

    def expire(self, v: Vessel, now: int) -> list[dict]:
        """What falls due by a time without a fix."""
        out = self.darkness(v, now)
        return [*out, *self.sweep(v, now)]

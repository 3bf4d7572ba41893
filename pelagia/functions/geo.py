"""Plane geometry of positions as column expressions: degrees in, metres and degrees out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M_PER_DEG = 111_320.0
M_PER_NM = 1_852.0
EPS = 1e-9


def _c(x: Column | float | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x written once, however often ``use`` names it: keeps expression trees small."""
    return F.transform(F.array(x), use)[0]


def meters_to_nm(m) -> Column:
    return _c(m) / M_PER_NM


def nm_to_meters(nm) -> Column:
    return _c(nm) * M_PER_NM


def knots_to_mps(kn) -> Column:
    return _c(kn) * M_PER_NM / 3600.0


def mps_to_knots(mps) -> Column:
    return _c(mps) * 3600.0 / M_PER_NM


def distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Flat-plane distance about the mean latitude."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    north = (lat2 - lat1) * M_PER_DEG
    east = (lon2 - lon1) * M_PER_DEG * F.cos(F.radians((lat1 + lat2) / 2.0))
    return F.sqrt(north * north + east * east)


def dead_reckon(lat, lon, heading_deg, dist_m) -> tuple[Column, Column]:
    """(lat, lon) after dist_m along a heading."""
    lat, lon, h, d = _c(lat), _c(lon), F.radians(_c(heading_deg)), _c(dist_m)
    return lat + d * F.cos(h) / M_PER_DEG, lon + d * F.sin(h) / (M_PER_DEG * F.cos(F.radians(lat)))


def bearing_deg(from_e, from_n, to_e, to_n) -> Column:
    angle = F.degrees(F.atan2(_c(to_e) - _c(from_e), _c(to_n) - _c(from_n)))
    return let(angle, lambda d: F.when(d < 0, d + 360.0).otherwise(d))


def smallest_positive_root(a, b, c) -> Column:
    """Least root above EPS of a t^2 + b t + c, or null; linear where a is 0."""

    def solve(k: Column) -> Column:
        a, b, c = k["a"], k["b"], k["c"]
        above = lambda t: let(t, lambda t: F.when(t > EPS, t))
        line = F.when(F.abs(b) >= EPS, above(F.try_divide(-c, b)))
        root = F.sqrt(let(b * b - 4.0 * a * c, lambda d: F.when(d >= 0, d)))
        square = let(root, lambda r: F.least(above(F.try_divide(-b - r, 2.0 * a)), above(F.try_divide(-b + r, 2.0 * a))))
        return F.when(F.abs(a) < EPS, line).otherwise(square)

    return let(F.struct(_c(a).alias("a"), _c(b).alias("b"), _c(c).alias("c")), solve)


def intercept(p_lat, p_lon, p_kn, t_lat, t_lon, t_kn, t_heading) -> Column:
    """STRUCT heading_deg, eta_s, feasible for a patrol at full speed against a target that keeps course and speed.

    Where no meeting is possible: the bearing to the target now and the time to get there; null time at speed 0.
    """
    p_lat, p_lon, p_kn, t_lat, t_lon, t_kn, h = map(_c, (p_lat, p_lon, p_kn, t_lat, t_lon, t_kn, t_heading))
    scale = M_PER_DEG * F.cos(F.radians(t_lat))
    speed = knots_to_mps(t_kn)
    plane = F.struct(
        ((p_lon - t_lon) * scale).alias("px"), ((p_lat - t_lat) * M_PER_DEG).alias("py"), knots_to_mps(p_kn).alias("own"),
        (speed * F.sin(F.radians(h))).alias("vx"), (speed * F.cos(F.radians(h))).alias("vy"),
    )

    def solve(k: Column) -> Column:
        px, py, vx, vy, own = (k[c] for c in ("px", "py", "vx", "vy", "own"))
        tau = smallest_positive_root(vx * vx + vy * vy - own * own, -2.0 * (px * vx + py * vy), px * px + py * py)
        return let(
            tau,
            lambda t: F.when(
                t.isNotNull(), F.struct(let(F.struct((vx * t).alias("x"), (vy * t).alias("y")), lambda m: bearing_deg(px, py, m["x"], m["y"])).alias("heading_deg"), t.alias("eta_s"), F.lit(True).alias("feasible"))
            ).otherwise(
                F.struct(bearing_deg(px, py, 0.0, 0.0).alias("heading_deg"), F.try_divide(F.sqrt(px * px + py * py), own).alias("eta_s"), F.lit(False).alias("feasible"))
            ),
        )

    return let(plane, solve)


def course(t_lat, t_kn, t_heading) -> dict[str, Column]:
    """What ``met`` needs of a target: metres in a degree of longitude, and its velocity."""
    t_lat, speed, h = _c(t_lat), knots_to_mps(t_kn), F.radians(_c(t_heading))
    return {"scale": M_PER_DEG * F.cos(F.radians(t_lat)), "vx": speed * F.sin(h), "vy": speed * F.cos(h)}


def met(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``intercept`` over rows of a target (_lat, _lon and its ``course``) and a patrol (_p: lat, lon, kn), step by step as plain
    columns: ``keep``, _p, _tau (null where no meeting is possible), _eta and _heading."""
    n, above = F.col, lambda t: F.when(n(t) > EPS, n(t))
    own = knots_to_mps("_p.kn")
    rows = rows.select(*keep, "_p", "_vx", "_vy", own.alias("_own"), ((n("_p.lon") - n("_lon")) * n("_scale")).alias("_px"), ((n("_p.lat") - n("_lat")) * M_PER_DEG).alias("_py"))
    rows = rows.withColumns({
        "_a": n("_vx") * n("_vx") + n("_vy") * n("_vy") - n("_own") * n("_own"),
        "_b": -2.0 * (n("_px") * n("_vx") + n("_py") * n("_vy")),
        "_c": n("_px") * n("_px") + n("_py") * n("_py"),
    })
    rows = rows.withColumn("_d", n("_b") * n("_b") - 4.0 * n("_a") * n("_c"))
    rows = rows.withColumn("_r", F.sqrt(F.when(n("_d") >= 0, n("_d"))))
    rows = rows.withColumns({
        "_line": F.when(F.abs("_b") >= EPS, F.try_divide(-n("_c"), n("_b"))),
        "_low": F.try_divide(-n("_b") - n("_r"), 2.0 * n("_a")),
        "_high": F.try_divide(-n("_b") + n("_r"), 2.0 * n("_a")),
    })
    rows = rows.withColumn("_tau", F.when(F.abs("_a") < EPS, above("_line")).otherwise(F.least(above("_low"), above("_high"))))
    rows = rows.withColumns({
        "_eta": F.coalesce("_tau", F.try_divide(F.sqrt("_c"), n("_own"))),
        "_angle": F.degrees(F.atan2(F.coalesce(n("_vx") * n("_tau"), F.lit(0.0)) - n("_px"), F.coalesce(n("_vy") * n("_tau"), F.lit(0.0)) - n("_py"))),
    })
    return rows.withColumn("_heading", F.when(n("_angle") < 0, n("_angle") + 360.0).otherwise(n("_angle")))


def point_segment_m(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point to a segment; to its end where it has no length."""
    px, py = _c(px), _c(py)
    ends = F.struct(*[_c(v).alias(k) for k, v in (("ax", ax), ("ay", ay), ("bx", bx), ("by", by))])

    def away(s: Column) -> Column:
        dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
        t = F.coalesce(F.try_divide((px - s["ax"]) * dx + (py - s["ay"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        off = let(clamped, lambda t: F.struct((px - (s["ax"] + t * dx)).alias("x"), (py - (s["ay"] + t * dy)).alias("y")))
        return let(off, lambda o: F.sqrt(o["x"] * o["x"] + o["y"] * o["y"]))

    return let(ends, away)


def segment_distance_m(lat, lon, x1, y1, x2, y2) -> Column:
    """Metres from a position to a zone's edge, in the plane about the position."""
    lat, lon = _c(lat), _c(lon)
    scale = M_PER_DEG * F.cos(F.radians(lat))
    to = lambda x, y: ((_c(x) - lon) * scale, (_c(y) - lat) * M_PER_DEG)
    return point_segment_m(0.0, 0.0, *to(x1, y1), *to(x2, y2))


def on_edge(x, y, x1, y1, x2, y2) -> Column:
    x, y, x1, y1, x2, y2 = map(_c, (x, y, x1, y1, x2, y2))
    cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
    return (
        (cross == 0.0)
        & (x >= F.least(x1, x2)) & (x <= F.greatest(x1, x2))
        & (y >= F.least(y1, y2)) & (y <= F.greatest(y1, y2))
    )


def crosses(x, y, x1, y1, x2, y2) -> Column:
    """Whether a ray to the east of a point crosses an edge."""
    x, y, x1, y1, x2, y2 = map(_c, (x, y, x1, y1, x2, y2))
    return F.when((y1 > y) != (y2 > y), x < (x2 - x1) * F.try_divide(y - y1, y2 - y1) + x1).otherwise(False)


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd containment in an array of rings of (lon, lat), edges inside, for rings held in a column."""

    def over(ring: Column, test: Callable[..., Column], start: Column, merge: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.size(ring) - 2),
            start,
            lambda acc, i: merge(acc, test(x, y, ring[i]["lon"], ring[i]["lat"], ring[i + 1]["lon"], ring[i + 1]["lat"])),
        )

    usable = F.filter(rings, lambda r: F.size(r) >= 2)
    edge = F.exists(usable, lambda r: over(r, on_edge, F.lit(False), lambda acc, hit: acc | hit))
    odd = F.aggregate(
        usable, F.lit(False), lambda acc, r: acc != over(r, crosses, F.lit(False), lambda a, hit: a != hit)
    )
    return edge | odd


def cell_index(deg, cell: float) -> Column:
    return F.floor(_c(deg) / cell).cast("int")

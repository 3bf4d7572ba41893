"""Spatial joins of fixes with zones.

Up to ``Settings.inline_zones`` zones are compiled into one expression per fix:
a narrow projection inside code generation, no join and no shuffle. More zones
go through an equi-join on grid cells: each zone is listed under every cell that
its bounds touch (so no thin zone is missed), candidates are tested exactly, and
the zones of a fix are gathered per (mmsi, seq), which the track operators'
partitioning by mmsi serves without another shuffle.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pelagia import schema as S
from pelagia.functions import geo, rules


def zone_rows(zones: DataFrame, most: int) -> list[Row]:
    """The zones as rows in order if there are at most ``most``, else an empty list: the caller has another way then."""
    rows = zones.limit(most + 1).collect()
    return sorted(rows, key=lambda z: z.zone_idx) if len(rows) <= most else []


def _edges(zone: Row) -> list[tuple[float, float, float, float]]:
    return [(a.lon, a.lat, b.lon, b.lat) for ring in zone.rings for a, b in zip(ring, ring[1:])]


def contains(zone: Row, lat: str = "lat", lon: str = "lon") -> Column:
    """Whether a zone holds a position, edges included; for a zone known to the driver.

    The expression is handed over as text: one call to the JVM, where columns take one for each operation.
    """
    edges = _edges(zone)
    corners = {(zone.min_lon, zone.min_lat), (zone.min_lon, zone.max_lat), (zone.max_lon, zone.min_lat), (zone.max_lon, zone.max_lat)}
    n = lambda v: f"{float(v)!r}D"
    inside = f"{lon} BETWEEN {n(zone.min_lon)} AND {n(zone.max_lon)} AND {lat} BETWEEN {n(zone.min_lat)} AND {n(zone.max_lat)}"
    if len(zone.rings) == 1 and len(edges) == 4 and {(x, y) for x, y, _, _ in edges} == corners and all(a == c or b == d for a, b, c, d in edges):
        return F.expr(inside)  # an upright rectangle is its own bounds
    odd, on = ["FALSE"], ["FALSE"]
    for x1, y1, x2, y2 in edges:
        if y1 != y2:  # a level edge is crossed by no level ray
            odd.append(f"(({n(y1)} > {lat}) <> ({n(y2)} > {lat}) AND {lon} < ({n(x2)} - {n(x1)}) * (({lat} - {n(y1)}) / ({n(y2)} - {n(y1)})) + {n(x1)})")
        on.append(
            f"(({lon} - {n(x1)}) * ({n(y2)} - {n(y1)}) - ({lat} - {n(y1)}) * ({n(x2)} - {n(x1)}) = 0D"
            f" AND {lon} BETWEEN {n(min(x1, x2))} AND {n(max(x1, x2))} AND {lat} BETWEEN {n(min(y1, y2))} AND {n(max(y1, y2))})"
        )
    # the tests are joined in balanced pairs, so that many edges don't nest deeply
    return F.expr(f"CASE WHEN {inside} THEN {_balanced(odd, '<>')} OR {_balanced(on, 'OR')} ELSE FALSE END")


def _balanced(terms: list[str], sign: str) -> str:
    if len(terms) == 1:
        return terms[0]
    half = len(terms) // 2
    return f"({_balanced(terms[:half], sign)} {sign} {_balanced(terms[half:], sign)})"


def distance_nm(zone: Row, lat: Column | str = "lat", lon: Column | str = "lon") -> Column:
    """Nautical miles from a position to a zone, 0 inside."""
    return distances_nm([zone], lat, lon)[0]["nm"]


def _about(zone: Row) -> Column:
    kind = zone.zone_kind
    return F.struct(*[F.lit(x).alias(n) for n, x in (("zone_idx", zone.zone_idx), ("zone_id", zone.zone_id), ("zone_kind", kind), ("country_code", zone.country_code))])


ZONES_INSIDE = "ARRAY<STRUCT<zone_idx: INT, zone_id: STRING, zone_kind: STRING, country_code: INT>>"


def inside_inline(fixes: DataFrame, rows: list[Row]) -> DataFrame:
    """fixes with "zones" (ZONES_INSIDE, in file order)."""
    found = F.array_compact(F.array(*[F.when(contains(z), _about(z)) for z in rows])) if rows else F.array()
    return fixes.withColumn("zones", found.cast(ZONES_INSIDE))


def zone_cells(zones: DataFrame, cell: float) -> DataFrame:
    """zones with "cx" and "cy": each cell that a zone's bounds touch."""
    span = lambda low, high: F.explode(F.sequence(geo.cell_index(low, cell), geo.cell_index(high, cell)))
    return zones.select("*", span("min_lon", "max_lon").alias("cx")).select("*", span("min_lat", "max_lat").alias("cy"))


def inside_by_cells(fixes: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """As inside_inline, for any number of zones. Large zones list many cells, so choose cells of the zones' scale."""
    cells = zone_cells(zones, cell)
    at = fixes.withColumn("cx", geo.cell_index("lon", cell)).withColumn("cy", geo.cell_index("lat", cell))
    hit = (
        at.select("mmsi", "seq", "lat", "lon", "cx", "cy")
        .join(cells, ["cx", "cy"])
        .where(F.col("lon").between(F.col("min_lon"), F.col("max_lon")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat")))
        .where(geo.in_rings(F.col("lon"), F.col("lat"), F.col("rings")))
    )
    found = hit.groupBy("mmsi", "seq").agg(
        F.array_sort(F.collect_list(F.struct("zone_idx", "zone_id", "zone_kind", "country_code"))).cast(ZONES_INSIDE).alias("zones")
    )
    return fixes.join(found, ["mmsi", "seq"], "left").withColumn("zones", F.coalesce("zones", F.array().cast(ZONES_INSIDE)))


def inside(fixes: DataFrame, zones: DataFrame, settings: S.Settings = S.Settings(), rows: list[Row] | None = None) -> DataFrame:
    """fixes with the zones that each is in. ``rows``: what ``zone_rows`` gave for at most ``inline_zones``, if it is known."""
    if rows is None:
        rows = zone_rows(zones, settings.inline_zones)
    return inside_inline(fixes, rows) if rows else inside_by_cells(fixes, zones, settings.cell_deg)


def interest(rows: list[Row]) -> list[Row]:
    """The zones near which silence counts: all but economic zones, or all if there are no others."""
    return [z for z in rows if z.zone_kind != S.EEZ] or rows


_NEAR = (
    "ARRAY<STRUCT<idx: INT, id: STRING, x1: DOUBLE, x2: DOUBLE, y1: DOUBLE, y2: DOUBLE, rings: ARRAY<ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>>, "
    "edges: ARRAY<STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>>>>"
)


def zones_literal(rows: list[Row]) -> Column:
    """Zones as one constant array of _NEAR."""
    out = [
        {
            "idx": z.zone_idx, "id": z.zone_id, "x1": z.min_lon, "x2": z.max_lon, "y1": z.min_lat, "y2": z.max_lat,
            "rings": [[{"lon": p.lon, "lat": p.lat} for p in r] for r in z.rings],
            "edges": [dict(zip(("x1", "y1", "x2", "y2"), e, strict=True)) for e in _edges(z)],
        }
        for z in rows
    ]
    return F.from_json(F.lit(json.dumps(out)), _NEAR)


def distances_nm(rows: list[Row], lat="lat", lon="lon") -> Column:
    """ARRAY of (nm, idx, id): miles to each zone, 0 inside, in the given order."""
    lat, lon = geo._c(lat), geo._c(lon)

    def one(z: Column) -> Column:
        inside = lon.between(z["x1"], z["x2"]) & lat.between(z["y1"], z["y2"]) & geo.in_rings(lon, lat, z["rings"])
        away = F.array_min(F.transform(z["edges"], lambda e: geo.segment_distance_m(lat, lon, e["x1"], e["y1"], e["x2"], e["y2"])))
        return F.struct(F.when(inside, 0.0).otherwise(geo.meters_to_nm(away)).alias("nm"), z["idx"].alias("idx"), z["id"].alias("id"))

    return F.transform(zones_literal(rows), one)


def maybe_near(rows: list[Row], nm: float, lat="lat", lon="lon") -> Column:
    """Whether a position is within ``nm`` miles of the bounds of a zone of interest: no distance is measured where it isn't."""
    lat, lon = geo._c(lat), geo._c(lon)
    reach = nm * geo.M_PER_NM * (1 + 1e-9)
    scale = geo.M_PER_DEG * F.cos(F.radians(lat))

    def near(z: Row) -> Column:
        north = ((z.min_lat - lat) * geo.M_PER_DEG <= reach) & ((lat - z.max_lat) * geo.M_PER_DEG <= reach)
        return north & ((z.min_lon - lon) * scale <= reach) & ((lon - z.max_lon) * scale <= reach)

    return reduce(or_, map(near, interest(rows)))


def nearest(rows: list[Row], lat="lat", lon="lon") -> Column:
    """(nm, idx, id) of the nearest zone of interest, the first in file order of equally near ones."""
    return F.array_min(distances_nm(interest(rows), lat, lon))


def near_by_cells(fixes: DataFrame, zones: DataFrame, nm: float, cell: float) -> DataFrame:
    """The fixes within ``nm`` miles of a zone of interest, with "near" (nm, idx, id) as by ``nearest``, for any number
    of zones: each is listed under the cells that its bounds, widened by the reach, touch."""
    others = zones.where(F.col("zone_kind") != S.EEZ)
    of_interest = others if others.limit(1).count() else zones
    reach = nm * geo.M_PER_NM * (1 + 1e-9) / geo.M_PER_DEG
    # a degree of longitude is shortest at the widened bounds' highest latitude; next to a pole every longitude is near
    high = F.least(F.lit(90.0), F.greatest(F.abs(F.col("min_lat") - reach), F.abs(F.col("max_lat") + reach)))
    wide = F.least(F.lit(360.0), F.try_divide(F.lit(reach), F.greatest(F.lit(1e-9), F.cos(F.radians(high)))))
    listed = zone_cells(
        of_interest.select(
            "zone_idx", "zone_id", "rings", F.col("min_lon").alias("x1"), F.col("max_lon").alias("x2"), F.col("min_lat").alias("y1"), F.col("max_lat").alias("y2"),
            F.greatest(F.lit(-180.0), F.col("min_lon") - wide).alias("min_lon"), F.least(F.lit(180.0), F.col("max_lon") + wide).alias("max_lon"),
            (F.col("min_lat") - reach).alias("min_lat"), (F.col("max_lat") + reach).alias("max_lat"),
        ),
        cell,
    ).drop("min_lon", "max_lon", "min_lat", "max_lat")
    at = fixes.withColumn("cx", geo.cell_index("lon", cell)).withColumn("cy", geo.cell_index("lat", cell))
    met = at.select("mmsi", "seq", "lat", "lon", "cx", "cy").join(listed, ["cx", "cy"])
    lat, lon = F.col("lat"), F.col("lon")
    inside = lon.between(F.col("x1"), F.col("x2")) & lat.between(F.col("y1"), F.col("y2")) & geo.in_rings(lon, lat, F.col("rings"))
    along = F.transform(
        F.filter("rings", lambda r: F.size(r) >= 2),
        lambda r: F.array_min(
            F.transform(
                F.sequence(F.lit(0), F.size(r) - 2),
                lambda i: geo.segment_distance_m(lat, lon, r[i]["lon"], r[i]["lat"], r[i + 1]["lon"], r[i + 1]["lat"]),
            )
        ),
    )
    away = F.when(inside, 0.0).otherwise(geo.meters_to_nm(F.array_min(along)))
    near = met.select("mmsi", "seq", F.struct(away.alias("nm"), F.col("zone_idx").alias("idx"), F.col("zone_id").alias("id")).alias("near"))
    found = near.where(F.col("near.nm") <= nm).groupBy("mmsi", "seq").agg(F.min("near").alias("near"))
    return fixes.join(found, ["mmsi", "seq"])


def illegal_here(zones: Column | str, flag: Column | str) -> Column:
    """Whether any of the zones that a fix is in makes its presence a violation."""
    flag = geo._c(flag)
    return F.exists(geo._c(zones), lambda z: rules.zone_violation(z["zone_kind"], z["country_code"], flag))

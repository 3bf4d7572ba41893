"""The detectors: zone entry, position jump, fishing gear, darkness. Each gives rows of ALERTS."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pelagia import schema as S
from pelagia.functions import geo, rules
from pelagia.operators import spatial, tracks

#: at_ms is when the engine can tell (the fix's time, or when silence passes its threshold); rank orders alerts of one time.
ALERTS = {
    "kind": "STRING", "mmsi": "LONG", "at_ms": "LONG", "rank": "INT", "ts_ms": "LONG", "seq": "LONG", "lat": "DOUBLE", "lon": "DOUBLE",
    "zone_id": "STRING", "detail": S.DETAIL, "cone": S.CONE, "intercepts": S.INTERCEPTS,
}


def _detail(**known: Column) -> Column:
    kinds = {"zone_kind": "string", "implied_speed_kn": "double", "pattern": "string", "sea_state_m": "double", "weather_confidence": "string", "silence_s": "double", "tier": "string"}
    return F.struct(*[known.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def _alerts(rows: DataFrame, also: tuple[str, ...] = (), **known: Column) -> DataFrame:
    """Columns of ALERTS: those given, else the row's own, else null; and the columns of the row named in ``also``."""
    cols = {}
    for name, kind in ALERTS.items():
        x = known[name] if name in known else F.col(name) if name in rows.columns else F.lit("") if name == "zone_id" else F.lit(None)
        cols[name] = x.cast(kind) if name not in ("detail",) else x
    return rows.select(*[x.alias(n) for n, x in cols.items()], *also)


def zone_violations(tracked: DataFrame) -> DataFrame:
    """A row per forbidden zone that a vessel enters; never on its first fix."""
    bad = F.filter(tracks.entered(), lambda z: rules.zone_violation(z["zone_kind"], z["country_code"], F.col("flag_code")))
    rows = tracked.where(F.col("prev").isNotNull() & (F.size("zones") > 0)).withColumn("z", F.explode(bad))
    return _alerts(
        rows, kind=F.lit(S.ZONE_VIOLATION), at_ms=F.col("ts_ms"), rank=F.col("z.zone_idx"), zone_id=F.col("z.zone_id"),
        detail=_detail(zone_kind=F.col("z.zone_kind")),
    )


def spoofs(tracked: DataFrame) -> DataFrame:
    """A row per jump that no vessel can make."""
    dist = geo.distance_m(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))
    dt = F.col("ts_ms") - F.col("prev.ts_ms")
    rows = tracked.where("prev.ts_ms <> 0").withColumns({"d": dist, "dt": dt}).where(rules.spoofed("d", "dt"))
    return _alerts(
        rows, kind=F.lit(S.SPOOF), at_ms=F.col("ts_ms"), rank=F.lit(1_000_000),
        detail=_detail(implied_speed_kn=rules.round1_away(rules.implied_kn("d", "dt"))),
    )


def fishing_candidates(tracked: DataFrame) -> DataFrame:
    """Rows whose ring looks like fishing where the vessel may not fish, before spacing. Needs "history".

    The ring is folded only for rows where presence is a violation and there is enough of a ring.
    """
    worth = F.col("prev").isNotNull() & (F.size("history") >= 8) & spatial.illegal_here("zones", "flag_code")
    rows = tracked.where(worth).withColumn("gear", _gear()).where("gear.kind is not null")
    return _alerts(rows, kind=F.col("gear.kind"), at_ms=F.col("ts_ms"), rank=F.lit(2_000_000), detail=_detail(pattern=F.col("gear.text")))


def _gear() -> Column:
    """(kind, text) of the ring, as one expression in which the ring is folded once."""

    def told(m: Column) -> Column:
        kind, text = tracks.fishing_pattern(m)
        return F.struct(kind.alias("kind"), text.alias("text"))

    return geo.let(tracks.track_measures("history"), told)


def fishing(tracked: DataFrame, settings: S.Settings = S.Settings()) -> DataFrame:
    """Fishing alerts, at most one per vessel in half an hour, whatever the gear."""
    found = fishing_candidates(tracked)
    return tracks.spaced(found, ["mmsi"], ["ts_ms", "seq"], "ts_ms", F.lit(settings.debounce_ms), strict=True, start_ms=0)


def _silent(settings: S.Settings) -> Column:
    """Whether a moving vessel's gap to its next fix, or to the end of observation, passes its threshold."""
    until = F.coalesce("next_ts_ms", F.lit(settings.as_of_ms).cast("long"))
    silent = (until - F.col("ts_ms")) / 1000.0 > rules.silence_threshold_s("speed_kn", settings)
    if settings.as_of_ms is None:
        silent = F.col("next_ts_ms").isNull() | silent
    return (F.col("speed_kn") > settings.dark_min_speed_kn) & silent


def silences(tracked: DataFrame, settings: S.Settings = S.Settings()) -> DataFrame:
    """Fixes of moving vessels after which they are silent beyond their threshold: with silence_s and detect_ms.

    A silence is told when it passes the threshold, so that is its length. One row per fix is one row per episode.
    """
    threshold = rules.silence_threshold_s("speed_kn", settings)
    rows = tracked.where(_silent(settings))
    return rows.withColumn("silence_s", threshold).withColumn("detect_ms", F.col("ts_ms") + F.ceil(threshold * 1000).cast("long"))


def patrol_intercepts(patrols: list[Row], lat: Column, lon: Column, speed_kn: Column, heading_deg: Column) -> Column:
    """Every patrol's solution, in patrol order."""
    known = [{"id": p.patrol_id, "lat": p.lat, "lon": p.lon, "kn": p.max_speed_kn} for p in sorted(patrols, key=lambda p: p.patrol_idx)]
    fixed = F.from_json(F.lit(json.dumps(known)), "ARRAY<STRUCT<id: STRING, lat: DOUBLE, lon: DOUBLE, kn: DOUBLE>>")
    target = F.struct(lat.alias("lat"), lon.alias("lon"), speed_kn.alias("kn"), heading_deg.alias("heading"))

    def solved(t: Column) -> Column:
        def one(p: Column) -> Column:
            met = geo.intercept(p["lat"], p["lon"], p["kn"], t["lat"], t["lon"], t["kn"], t["heading"])
            return geo.let(
                met,
                lambda m: F.struct(p["id"].alias("patrol_id"), rules.round1(m["heading_deg"]).alias("heading_deg"), rules.round1(m["eta_s"]).alias("eta_s"), m["feasible"].alias("feasible")),
            )

        return F.transform(fixed, one)

    return geo.let(target, solved).cast(S.INTERCEPTS)


def intercept_rows(silent: DataFrame, patrols: list[Row], keep: tuple[str, ...] = ("mmsi", "ts_ms", "seq")) -> DataFrame:
    """A row per silence and patrol: the columns to ``keep``, patrol_id, heading_deg, eta_s and feasible, with the numbers of
    ``patrol_intercepts``. For large fleets: plain columns over rows are compiled, and a column that nobody reads is
    not computed; an array's lambdas are interpreted for each patrol."""
    known = [{"id": p.patrol_id, "lat": p.lat, "lon": p.lon, "kn": p.max_speed_kn} for p in sorted(patrols, key=lambda p: p.patrol_idx)]
    fleet = F.from_json(F.lit(json.dumps(known)), "ARRAY<STRUCT<id: STRING, lat: DOUBLE, lon: DOUBLE, kn: DOUBLE>>")
    lat, lon = predicted(F.col("speed_kn"), F.col("silence_s"), F.col("lat"), F.col("lon"), F.col("heading_deg"))
    rows = silent.select(*keep, lat.alias("_lat"), lon.alias("_lon"), F.col("speed_kn").alias("_kn"), F.col("heading_deg").alias("_h"))
    rows = rows.select(*keep, "_lat", "_lon", *[x.alias(f"_{n}") for n, x in geo.course("_lat", "_kn", "_h").items()])
    rows = rows.select("*", F.explode(fleet).alias("_p"))
    return geo.met(rows, keep).select(*keep, F.col("_p.id").alias("patrol_id"), rules.round1("_heading").alias("heading_deg"), rules.round1("_eta").alias("eta_s"), F.col("_tau").isNotNull().alias("feasible"))


def predicted(speed_kn: Column, silence_s: Column, lat: Column, lon: Column, heading: Column) -> tuple[Column, Column]:
    return geo.dead_reckon(lat, lon, heading, geo.knots_to_mps(speed_kn) * silence_s)


def near_silences(tracked: DataFrame, zones: list[Row], settings: S.Settings = S.Settings()) -> DataFrame:
    """Silences that begin near a zone of interest, with "near" (nm, idx, id).

    The distance to the zones is worked out for silent fixes only.
    """
    close = spatial.maybe_near(zones, settings.dark_near_nm)
    return silences(tracked, settings).where(close).withColumn("near", spatial.nearest(zones)).where(F.col("near.nm") <= settings.dark_near_nm)


def dark_events(tracked: DataFrame, zones: list[Row], patrols: list[Row], settings: S.Settings = S.Settings()) -> DataFrame:
    """Silences that begin near a zone of interest, with the cone of where the vessel may be and every patrol's intercept."""
    return _alerts(near_silences(tracked, zones, settings), **_dark(patrols, settings, F.col("near")))


def dark_events_by_cells(tracked: DataFrame, zones: DataFrame, patrols: list[Row], settings: S.Settings = S.Settings()) -> DataFrame:
    """As dark_events, for any number of zones: silent fixes meet the zones by grid cells."""
    rows = spatial.near_by_cells(silences(tracked, settings), zones, settings.dark_near_nm, settings.cell_deg)
    return _alerts(rows, **_dark(patrols, settings, F.col("near")))


def _dark(patrols: list[Row], settings: S.Settings, near: Column) -> dict[str, Column]:
    """What a dark event says, from a silent fix with "silence_s" and "detect_ms", and the zone near it."""
    speed, silence = F.col("speed_kn"), F.col("silence_s")
    lat, lon = predicted(speed, silence, F.col("lat"), F.col("lon"), F.col("heading_deg"))
    radius = settings.cone_r0_m + 0.1 * geo.knots_to_mps(speed) * silence
    cone = F.struct(
        F.col("lat"), F.col("lon"), F.col("heading_deg"), F.lit(settings.cone_spread_deg).alias("spread_deg"), rules.round1(radius).alias("radius_m")
    )
    met = patrol_intercepts(patrols, lat, lon, speed, F.col("heading_deg")) if patrols else F.array().cast(S.INTERCEPTS)
    return {
        "kind": F.lit(S.DARK), "at_ms": F.col("detect_ms"), "rank": F.lit(3_000_000), "zone_id": near["id"],
        "detail": _detail(silence_s=rules.round1(silence)), "cone": cone, "intercepts": met,
    }


def all_at_once(tracked: DataFrame, zones: list[Row], patrols: list[Row], settings: S.Settings = S.Settings()) -> DataFrame:
    """ALERTS of every detector in one pass over tracked fixes with "history"; fishing candidates are not spaced yet.
    Without ``zones`` it leaves out darkness.

    A row's alerts are one array. Rings are folded and zones measured once in it, and only where a look at the row
    says that they matter.
    """
    moved = geo.distance_m(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))
    dt = F.col("ts_ms") - F.col("prev.ts_ms")
    known = F.col("prev").isNotNull()
    bad = F.filter(tracks.entered(), lambda z: rules.zone_violation(z["zone_kind"], z["country_code"], F.col("flag_code")))
    worth = known & (F.size("history") >= 8) & spatial.illegal_here("zones", "flag_code")
    threshold = rules.silence_threshold_s("speed_kn", settings)
    rows = tracked.withColumns({"d": moved, "dt": dt, "silence_s": threshold, "detect_ms": F.col("ts_ms") + F.ceil(threshold * 1000).cast("long")})

    def row(**said: Column) -> Column:
        own = {"mmsi", "ts_ms", "seq", "lat", "lon"}
        cols = {n: said[n] if n in said else F.col(n) if n in own else F.lit("") if n == "zone_id" else F.lit(None) for n in ALERTS}
        return F.struct(*[x.cast(ALERTS[n]).alias(n) for n, x in cols.items()])

    at = F.col("ts_ms")
    entries = F.transform(
        F.when(known & (F.size("zones") > 0), bad),
        lambda z: row(kind=F.lit(S.ZONE_VIOLATION), at_ms=at, rank=z["zone_idx"], zone_id=z["zone_id"], detail=_detail(zone_kind=z["zone_kind"])),
    )
    jump = row(kind=F.lit(S.SPOOF), at_ms=at, rank=F.lit(1_000_000), detail=_detail(implied_speed_kn=rules.round1_away(rules.implied_kn("d", "dt"))))
    jumps = F.when((F.col("prev.ts_ms") != 0) & rules.spoofed("d", "dt"), F.array(jump))
    gears = F.when(
        worth,
        geo.let(_gear(), lambda g: F.when(g["kind"].isNotNull(), F.array(row(kind=g["kind"], at_ms=at, rank=F.lit(2_000_000), detail=_detail(pattern=g["text"]))))),
    )
    darks = zones and F.when(
        _silent(settings) & spatial.maybe_near(zones, settings.dark_near_nm), geo.let(spatial.nearest(zones), lambda n: F.when(n["nm"] <= settings.dark_near_nm, F.array(row(**_dark(patrols, settings, n)))))
    )
    found = F.flatten(F.array_compact(F.array(entries, jumps, gears, *([darks] if zones else []))))
    return rows.select(F.explode(found).alias("a")).select("a.*")


def spaced_fishing(found: DataFrame, settings: S.Settings = S.Settings()) -> DataFrame:
    """Alerts with the fishing ones at most one per vessel in half an hour. Reads ``found`` twice: pass one that is
    written, so that only fishing alerts go through the sorted pass."""
    gear = F.col("kind").isin(*S.FISHING_KINDS)
    kept = tracks.spaced(found.where(gear), ["mmsi"], ["ts_ms", "seq"], "ts_ms", F.lit(settings.debounce_ms), strict=True, start_ms=0)
    return found.where(~gear).unionByName(kept)

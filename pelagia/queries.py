"""Registered queries over the events table as fixes, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia import schema as S
from pelagia.functions import geo, rules
from pelagia.operators import detectors, feed, metrics, risk, spatial, tracks
from pelagia.plans import demo, sql
from pelagia.plans.engine import Engine, patrol_rows, with_weather
from pelagia.sources import dimensions
from pelagia.sources import fixes as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SNAPSHOT_MS = 1_705_536_000_000  # a moment in the middle of the month


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    fix = demo.fixes(spark, sf_dir)
    return Engine(fix, demo.zones(spark), demo.patrols(spark), demo.names(fix), settings=demo.SETTINGS)


def _zones(spark: SparkSession) -> list:
    return spatial.zone_rows(demo.zones(spark), len(demo.ZONES))


# --- sources --------------------------------------------------------------------------------------


@query(sql.upto("fixes", "SELECT * FROM fixes"))
def ais_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.fixes(spark, sf_dir)


@query(
    f"""WITH raw AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 * 1000 AS ms FROM events)
SELECT 219000000 + user_id AS mmsi, CAST(55 + (event_id % 100) / 100.0 AS DOUBLE) AS lat, CAST(10 + (event_id % 7) / 10.0 AS DOUBLE) AS lon,
  CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE (event_id % 300) / 10.0 END::FLOAT::DOUBLE AS speed_kn,
  CASE WHEN event_id % 3 = 0 THEN (event_id % 360) ELSE (event_id % 180) END::DOUBLE AS heading_deg, ms AS ts_ms, 4 AS flag_code, 'SHIP ' || user_id AS name
FROM raw WHERE event_id % 13 <> 0 AND event_id % 17 <> 0"""
)
def ais_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of AIS CSV made of events, with the field's usual blemishes, and parsed."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    text = lambda c: c.cast("string")
    line = F.concat_ws(
        ",",
        F.date_format(F.col("ts").cast("timestamp"), "dd/MM/yyyy HH:mm:ss"),
        F.when(i % 13 == 0, "Base Station").otherwise("Class A"),
        F.concat(F.lit(" "), text(219_000_000 + F.col("user_id"))),
        F.when(i % 17 == 0, "91.0").otherwise(text(F.round(55 + (i % 100) / 100.0, 2))),
        text(F.round(10 + (i % 7) / 10.0, 1)),
        F.lit("Under way"), F.lit(""),
        F.when(i % 11 == 0, "102.3").otherwise(text((i % 300) / 10.0)),
        text(i % 180),
        F.when(i % 3 == 0, text(i % 360)).otherwise("511"),
        F.lit(""), F.lit(""),
        F.concat(F.lit("SHIP "), text(F.col("user_id"))),
        F.lit("Cargo"),
    )
    return sources.parse_csv(e.select(line.alias("value"))).drop("seq")


@query(
    """SELECT CASE WHEN event_id % 5 = 0 THEN 244000000 + user_id ELSE 219000000 + user_id END AS mmsi,
  CASE WHEN event_id % 7 = 0 THEN 52.5 ELSE 54.25 END AS lat, CASE WHEN event_id % 7 = 0 THEN 4.5 ELSE 10.75 END AS lon,
  CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE (event_id % 100) / 4.0 END AS speed_kn, CASE WHEN event_id % 2 = 0 THEN event_id % 360 ELSE event_id % 90 END::DOUBLE AS heading_deg,
  event_id AS ts_ms, CASE WHEN event_id % 5 = 0 THEN 3 ELSE 4 END AS flag_code FROM events WHERE event_id % 4 <> 0"""
)
def live_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live JSON frames made of events, decoded and normalised."""
    i, u = F.col("event_id"), F.col("user_id")
    report = F.struct(
        F.when(i % 5 == 0, 0).otherwise(219_000_000 + u).alias("UserID"), F.when(i % 9 == 0, 102.3).otherwise((i % 100) / 4.0).alias("Sog"), (i % 90).cast("double").alias("Cog"),
        F.when(i % 2 == 0, i % 360).otherwise(511).cast("int").alias("TrueHeading"), F.when(i % 7 == 0, 0.0).otherwise(54.25).alias("Latitude"), F.when(i % 7 == 0, 0.0).otherwise(10.75).alias("Longitude"),
    )
    about = F.struct((244_000_000 + u).alias("MMSI"), F.lit(" A ").alias("ShipName"), F.lit(52.5).alias("latitude"), F.lit(4.5).alias("longitude"))
    body = F.struct(F.lit("PositionReport").alias("MessageType"), about.alias("MetaData"), F.struct(report.alias("PositionReport")).alias("Message"))
    frames = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(i % 4 == 0, "{broken").otherwise(F.to_json(body)).alias("value"), i.alias("at"))
    return sources.normalize_live(sources.decode_live(frames, received_ms=F.col("at"))).drop("seq", "name")


@query(
    """SELECT CASE WHEN range % 50 = 0 THEN 420000000 + (range // 50) % 64 ELSE 419000000 + range % 100000 END AS mmsi,
  round(CASE WHEN range % 50 = 0 THEN CASE WHEN ((range // 50) // 64) % 2 = 0 THEN 8.95 ELSE 8.85 END ELSE 8.5 + fmod((range % 100000) * 0.000173::DOUBLE, 1.4::DOUBLE) END, 6) AS lat,
  round(CASE WHEN range % 50 = 0 THEN 79.10 + ((range // 50) % 64) * 0.002 ELSE 78.5 + fmod((range % 100000) * 0.000239::DOUBLE, 2.2::DOUBLE) END, 6) AS lon,
  CASE WHEN range % 50 = 0 THEN 8 ELSE 2 + range % 100000 % 22 END::DOUBLE AS speed_kn, CASE WHEN range % 50 = 0 THEN 0 ELSE range % 100000 % 360 END::DOUBLE AS heading_deg,
  1720000000000 + CASE WHEN range % 50 = 0 THEN ((range // 50) // 64) * 600000 ELSE 0 END AS ts_ms,
  CASE WHEN range % 50 = 0 OR range % 100000 % 3 = 0 THEN 2 ELSE 1 END AS flag_code, range AS seq FROM range(20000)"""
)
def firehose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.firehose(spark, 20_000)
    return rows.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


# --- geometry -------------------------------------------------------------------------------------


@query(
    sql.upto("fixes", f"""SELECT mmsi, seq, round(sqrt(pow((lat - 55.4) * {sql.M}, 2) + pow((lon - 11.0) * {sql.M} * cos(radians((55.4 + lat) / 2.0)), 2)), 3) AS meters,
  round(speed_kn * 1852.0 / 3600.0, 6) AS mps FROM fixes""")
)
def geo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = demo.fixes(spark, sf_dir)
    return f.select("mmsi", "seq", F.round(geo.distance_m(55.4, 11.0, "lat", "lon"), 3).alias("meters"), F.round(geo.knots_to_mps("speed_kn"), 6).alias("mps"))


@query(
    sql.upto("fixes", f"""SELECT mmsi, seq, round(lat + d * cos(radians(heading_deg)) / {sql.M}, 6) AS p_lat,
  round(lon + d * sin(radians(heading_deg)) / ({sql.M} * cos(radians(lat))), 6) AS p_lon FROM (SELECT *, speed_kn * 1852.0 / 3600.0 * 600 AS d FROM fixes)""")
)
def dead_reckon(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = geo.dead_reckon("lat", "lon", "heading_deg", geo.knots_to_mps("speed_kn") * 600)
    return demo.fixes(spark, sf_dir).select("mmsi", "seq", F.round(lat, 6).alias("p_lat"), F.round(lon, 6).alias("p_lon"))


_INTERCEPT = f"""plane AS (SELECT s.*, p.patrol_id, (p_lon0 - t_lon) * {sql.M} * cos(radians(t_lat)) AS px, (p_lat0 - t_lat) * {sql.M} AS py,
    speed_kn * 1852.0 / 3600.0 * sin(radians(heading_deg)) AS vx, speed_kn * 1852.0 / 3600.0 * cos(radians(heading_deg)) AS vy, p_kn * 1852.0 / 3600.0 AS own
  FROM target s CROSS JOIN (SELECT patrol_id, p_lat AS p_lat0, p_lon AS p_lon0, p_kn FROM patrols) p),
quad AS (SELECT *, vx * vx + vy * vy - own * own AS a, -2.0 * (px * vx + py * vy) AS b, px * px + py * py AS c FROM plane),
roots AS (SELECT *, CASE WHEN abs(a) < 1e-9 THEN CASE WHEN abs(b) >= 1e-9 AND -c / b > 1e-9 THEN -c / b END
    WHEN b * b - 4.0 * a * c >= 0 THEN least(
      CASE WHEN (-b - sqrt(b * b - 4.0 * a * c)) / (2.0 * a) > 1e-9 THEN (-b - sqrt(b * b - 4.0 * a * c)) / (2.0 * a) END,
      CASE WHEN (-b + sqrt(b * b - 4.0 * a * c)) / (2.0 * a) > 1e-9 THEN (-b + sqrt(b * b - 4.0 * a * c)) / (2.0 * a) END) END AS tau FROM quad),
met AS (SELECT *, degrees(CASE WHEN tau IS NULL THEN atan2(0.0 - px, 0.0 - py) ELSE atan2(vx * tau - px, vy * tau - py) END) AS ang,
    CASE WHEN tau IS NULL THEN sqrt(c) / own ELSE tau END AS eta, tau IS NOT NULL AS feasible FROM roots),
solved AS (SELECT *, CASE WHEN ang < 0 THEN ang + 360 ELSE ang END AS brg FROM met)"""


@query(
    sql.upto("dims", "SELECT mmsi, seq, patrol_id, round(brg, 3) AS heading_deg, round(eta, 3) AS eta_s, feasible FROM solved",
             f"target AS (SELECT mmsi, seq, lat AS t_lat, lon AS t_lon, speed_kn, heading_deg FROM fixes), {_INTERCEPT}")
)
def intercept_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = demo.fixes(spark, sf_dir).join(F.broadcast(demo.patrols(spark).select("patrol_id", F.col("lat").alias("a"), F.col("lon").alias("b"), "max_speed_kn")))
    got = each.select("mmsi", "seq", "patrol_id", geo.intercept("a", "b", "max_speed_kn", "lat", "lon", "speed_kn", "heading_deg").alias("i"))
    return got.select("mmsi", "seq", "patrol_id", F.round("i.heading_deg", 3).alias("heading_deg"), F.round("i.eta_s", 3).alias("eta_s"), "i.feasible")


@query(sql.upto("member", "SELECT mmsi, seq, zone_id, zone_kind FROM member"))
def zone_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spatial.inside(demo.fixes(spark, sf_dir), demo.zones(spark))
    return rows.select("mmsi", "seq", F.explode("zones").alias("z")).select("mmsi", "seq", "z.zone_id", "z.zone_kind")


@query(ORACLES["zone_membership"])
def zone_membership_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the join on grid cells that many zones take."""
    rows = spatial.inside_by_cells(demo.fixes(spark, sf_dir), demo.zones(spark), 0.25)
    return rows.select("mmsi", "seq", F.explode("zones").alias("z")).select("mmsi", "seq", "z.zone_id", "z.zone_kind")


@query(sql.upto("member", "SELECT mmsi, seq, zone_id, round(nm, 4) AS nm FROM dist", sql.distance("fixes")))
def zone_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = demo.fixes(spark, sf_dir).select("mmsi", "seq", F.explode(spatial.distances_nm(_zones(spark))).alias("d"))
    return each.select("mmsi", "seq", F.col("d.id").alias("zone_id"), F.round("d.nm", 4).alias("nm"))


@query(
    sql.upto("member", "SELECT mmsi, seq, arg_min(zone_id, (nm, zone_idx)) AS zone_id, round(min(nm), 4) AS nm FROM dist WHERE zone_kind <> 'eez' GROUP BY ALL", sql.distance("fixes"))
)
def nearest_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = demo.fixes(spark, sf_dir).select("mmsi", "seq", spatial.nearest(_zones(spark)).alias("z"))
    return near.select("mmsi", "seq", F.col("z.id").alias("zone_id"), F.round("z.nm", 4).alias("nm"))


@query(sql.upto("member", "SELECT mmsi, seq FROM dist WHERE zone_kind <> 'eez' GROUP BY ALL HAVING min(nm) <= 5", sql.distance("fixes")))
def near_zone_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.fixes(spark, sf_dir).where(spatial.nearest(_zones(spark))["nm"] <= 5.0).select("mmsi", "seq")


@query(sql.upto("fixes", "SELECT CAST(floor((lon + 0.0025) / 0.05) AS INT) AS cx, CAST(floor((lat + 0.0025) / 0.05) AS INT) AS cy, count(*) AS n FROM fixes GROUP BY ALL"))
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: geo.cell_index(F.col(c) + 0.0025, 0.05)
    return demo.fixes(spark, sf_dir).groupBy(cell("lon").alias("cx"), cell("lat").alias("cy")).agg(F.count(F.lit(1)).alias("n"))


# --- tracks and detectors -------------------------------------------------------------------------


@query(sql.upto("zone_spoof", "SELECT mmsi, ts_ms, seq, zone_id, zone_kind FROM zv"))
def zone_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.zone_violations(engine(spark, sf_dir).tracked(history=False))
    return found.select("mmsi", "ts_ms", "seq", "zone_id", F.col("detail.zone_kind").alias("zone_kind"))


@query(sql.upto("zone_spoof", "SELECT mmsi, ts_ms, seq, round(kn * 10) / 10 AS implied_speed_kn FROM sp"))
def spoof_teleport(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.spoofs(tracks.with_previous(demo.fixes(spark, sf_dir)))
    return found.select("mmsi", "ts_ms", "seq", "detail.implied_speed_kn")


@query(
    sql.upto("tracked", "SELECT mmsi, seq, len(hist) AS n, hist[1].ts AS oldest_ms, hist[-1].ts AS newest_ms, round(coalesce(list_sum([x.s FOR x IN hist]), 0), 4) AS sum_kn FROM tracked")
)
def fix_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks.with_history(demo.fixes(spark, sf_dir))
    h = F.col("history")
    return rows.select(
        "mmsi", "seq", F.size(h).cast("long").alias("n"), F.get(h, F.lit(0))["ts_ms"].alias("oldest_ms"), F.try_element_at(h, F.lit(-1))["ts_ms"].alias("newest_ms"),
        F.round(F.aggregate(h, F.lit(0.0), lambda a, f: a + f["speed_kn"]), 4).alias("sum_kn"),
    )


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.with_history(demo.fixes(spark, sf_dir)).select("mmsi", "seq", tracks.track_measures().alias("m")).where("m is not null").select("mmsi", "seq", "m.*")


@query(sql.upto("measured", "SELECT mmsi, seq, round(std, 4) AS std FROM spread WHERE r > 1e-6 AND r < 1 - 1e-9"))
def course_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measured(spark, sf_dir).withColumn("r", F.sqrt(F.col("mean_sin") ** 2 + F.col("mean_cos") ** 2)).where("r > 1e-6 and r < 1 - 1e-9")
    return rows.select("mmsi", "seq", F.round(rules.course_std("mean_sin", "mean_cos"), 4).alias("std"))


@query(sql.upto("measured", "SELECT mmsi, seq, CAST(rot AS DOUBLE) AS rot FROM measured"))
def net_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("mmsi", "seq", F.col("net_rotation").alias("rot"))


@query(sql.upto("measured", "SELECT mmsi, seq, crossings, min_kn, max_kn, round(avg_kn, 6) AS avg_kn FROM measured"))
def speed_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("mmsi", "seq", "crossings", "min_kn", "max_kn", F.round("avg_kn", 6).alias("avg_kn"))


@query(sql.upto("fishing", "SELECT mmsi, seq, ts_ms, kind, pattern FROM cand"))
def fishing_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.fishing_candidates(engine(spark, sf_dir).tracked())
    return found.select("mmsi", "seq", "ts_ms", "kind", F.col("detail.pattern").alias("pattern"))


@query(sql.upto("fishing", "SELECT mmsi, seq, ts_ms, kind, pattern FROM fishing"))
def fishing_debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.fishing(engine(spark, sf_dir).tracked())
    return found.select("mmsi", "seq", "ts_ms", "kind", F.col("detail.pattern").alias("pattern"))


@query(
    sql.upto("dark", f"""SELECT mmsi, ts_ms, detect_ms, near_id AS zone_id, trunc(silence_s * 10 + 0.5) / 10 AS silence_s, lat, lon,
  trunc((100 + 0.1 * (speed_kn * {sql.NM} / 3600.0) * silence_s) * 10 + 0.5) / 10 AS radius_m FROM dark""")
)
def dark_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    found = detectors.dark_events(e.tracked(history=False), _zones(spark), e.patrols.collect(), e.settings)
    return found.select("mmsi", "ts_ms", F.col("at_ms").alias("detect_ms"), "zone_id", "detail.silence_s", "lat", "lon", "cone.radius_m")


@query(
    sql.upto("dark", "SELECT mmsi, ts_ms, patrol_id, trunc(brg * 10 + 0.5) / 10 AS heading_deg, trunc(eta * 10 + 0.5) / 10 AS eta_s, feasible FROM solved",
             f"""target AS (SELECT mmsi, seq, ts_ms, speed_kn, heading_deg, lat + reach * cos(radians(heading_deg)) / {sql.M} AS t_lat,
  lon + reach * sin(radians(heading_deg)) / ({sql.M} * cos(radians(lat))) AS t_lon FROM (SELECT *, speed_kn * {sql.NM} / 3600.0 * silence_s AS reach FROM dark)), {_INTERCEPT}""")
)
def dark_intercepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    found = detectors.dark_events(e.tracked(history=False), _zones(spark), e.patrols.collect(), e.settings)
    return found.select("mmsi", "ts_ms", F.explode("intercepts").alias("i")).select("mmsi", "ts_ms", "i.*")


#: A fleet as (id, lat, lon, speed) of a number below FLEET.
FLEET = 1_500
_FLEET = {"patrol_id": "'B' || CAST(k AS VARCHAR(9))", "lat": "54.8E0 + (k % 50) * 0.06E0", "lon": "10.0E0 + (k % 31) * 0.09E0", "kn": "15.0E0 + k % 20"}


@query(
    sql.upto("dark", "SELECT mmsi, ts_ms, count(*) AS n, count(*) FILTER (feasible) AS n_feasible, min(trunc(eta * 10 + 0.5) / 10) AS soonest_s FROM solved GROUP BY ALL",
             f"""target AS (SELECT mmsi, seq, ts_ms, speed_kn, heading_deg, lat + reach * cos(radians(heading_deg)) / {sql.M} AS t_lat,
  lon + reach * sin(radians(heading_deg)) / ({sql.M} * cos(radians(lat))) AS t_lon FROM (SELECT *, speed_kn * {sql.NM} / 3600.0 * silence_s AS reach FROM dark)),
fleet AS (SELECT {_FLEET["patrol_id"]} AS patrol_id, {_FLEET["lat"]} AS p_lat, {_FLEET["lon"]} AS p_lon, {_FLEET["kn"]} AS p_kn FROM (SELECT range AS k FROM range({FLEET}))),
{_INTERCEPT.replace("FROM patrols) p", "FROM fleet) p")}""")
)
def dark_intercepts_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dark event against a large fleet: how many boats can meet it, and how soon the first is there."""
    e = engine(spark, sf_dir)
    boats = spark.range(FLEET).selectExpr("CAST(id AS INT) AS patrol_idx", "CAST(id AS INT) AS k").selectExpr(
        "patrol_idx", f"{_FLEET['patrol_id']} AS patrol_id", f"{_FLEET['lat']} AS lat", f"{_FLEET['lon']} AS lon", f"{_FLEET['kn']} AS max_speed_kn"
    )
    silent = detectors.near_silences(e.tracked(history=False), _zones(spark), e.settings)
    met = detectors.intercept_rows(silent, patrol_rows(boats), ("mmsi", "ts_ms")).groupBy("mmsi", "ts_ms")
    return met.agg(F.count(F.lit(1)).alias("n"), F.count_if("feasible").alias("n_feasible"), F.min("eta_s").alias("soonest_s"))


# --- risk -----------------------------------------------------------------------------------------


@query(sql.upto("scored", "SELECT kind, mmsi, at_ms, rank, seq, score, severity FROM scored"))
def risk_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).scored().select("kind", "mmsi", "at_ms", "rank", "seq", "score", "severity")


_AT = f"""latest AS (SELECT * FROM state WHERE at_ms <= {SNAPSHOT_MS} QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY at_ms DESC, rank DESC, seq DESC) = 1),
snap AS (SELECT mmsi, {sql.score(str(SNAPSHOT_MS))} AS score FROM latest)"""


@query(sql.upto("events", f"SELECT mmsi, score, {sql.TIER} AS tier FROM snap", _AT))
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.snapshot(engine(spark, sf_dir).detected(), SNAPSHOT_MS, demo.SETTINGS).select("mmsi", "score", "tier")


@query(sql.upto("events", f"SELECT {sql.TIER} AS tier, count(*) AS n, max(score) AS top FROM snap GROUP BY ALL", _AT))
def risk_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = risk.snapshot(engine(spark, sf_dir).detected(), SNAPSHOT_MS, demo.SETTINGS)
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))


@query(
    sql.upto("sweeps", f"""SELECT s.mmsi, s.sweep_ms AS ts_ms, s.score, {sql.TIER.replace("score", "s.score")} AS tier,
  coalesce(arg_max(f.lat, (f.ts_ms, f.seq)), 0) AS lat, coalesce(arg_max(f.lon, (f.ts_ms, f.seq)), 0) AS lon
FROM swept s LEFT JOIN fixes f ON f.mmsi = s.mmsi AND f.ts_ms <= s.sweep_ms WHERE s.score >= 65 AND coalesce(s.before, 0) < 65 GROUP BY ALL""")
)
def suspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return e.suspected(e.detected()).select("mmsi", "ts_ms", "score", F.col("detail.tier").alias("tier"), "lat", "lon")


@query(
    sql.upto("scored", """SELECT a.mmsi, a.at_ms, a.kind, a.seq, round(w.wave_m * 10) / 10 AS sea_state_m, nullif(conf, '') AS weather_confidence,
  CASE WHEN conf = 'LOW' THEN 'MEDIUM' ELSE severity END AS severity
FROM (SELECT a.*, w.wave_m, CASE WHEN kind = 'TRAWLING' AND w.wave_m >= 2.0 OR kind = 'LONGLINING' AND w.wave_m >= 2.5 THEN 'LOW'
    WHEN kind IN ('TRAWLING', 'LONGLINING') AND w.wave_m < 0.8 THEN 'HIGH' ELSE '' END AS conf
  FROM scored a ASOF LEFT JOIN weather w ON a.at_ms >= w.updated_ms WHERE kind IN ('TRAWLING', 'LONGLINING', 'PURSE_SEINING') AND a.at_ms - w.updated_ms <= 1800000) a, (SELECT a.wave_m) w""", sql.WEATHER)
)
def weather_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_weather(engine(spark, sf_dir).scored(), demo.weather(spark), demo.SETTINGS).where(F.col("kind").isin(*S.FISHING_KINDS))
    return rows.select("mmsi", "at_ms", "kind", "seq", "detail.sea_state_m", "detail.weather_confidence", "severity")


# --- feed, frames, presentation -------------------------------------------------------------------


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).alerts()


_ALL = f"""tiers AS (SELECT mmsi, sweep_ms, score FROM swept WHERE score >= 65 AND coalesce(before, 0) < 65),
alerts0 AS (SELECT kind, mmsi, at_ms, rank, seq, zone_id, severity, score, lat, lon FROM scored
  UNION ALL SELECT 'ILLEGAL_FISHING_SUSPECTED', t.mmsi, t.sweep_ms, 4000000, 0, '', 'HIGH', t.score, coalesce(arg_max(f.lat, (f.ts_ms, f.seq)), 0), coalesce(arg_max(f.lon, (f.ts_ms, f.seq)), 0)
    FROM tiers t LEFT JOIN fixes f ON f.mmsi = t.mmsi AND f.ts_ms <= t.sweep_ms GROUP BY ALL),
alerts AS (SELECT *, 'a-' || lpad(row_number() OVER (ORDER BY at_ms, rank, mmsi, seq, zone_id)::VARCHAR, 6, '0') AS id, CASE WHEN mmsi % 3 = 0 THEN 'VESSEL-' || mmsi ELSE '' END AS name FROM alerts0)"""


@query(sql.upto("sweeps", "SELECT id, kind, severity, mmsi, name, at_ms, zone_id, score FROM alerts", _ALL))
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alert of the engine, numbered."""
    return _alerts(spark, sf_dir).select("id", "kind", "severity", "mmsi", "name", "at_ms", "zone_id", "score")


_CODED = """, coded AS (SELECT *, CASE kind WHEN 'ZONE_VIOLATION' THEN 0 WHEN 'SPOOF_TELEPORT' THEN 1 WHEN 'DARK_EVENT' THEN 2 WHEN 'ILLEGAL_FISHING_SUSPECTED' THEN 3 ELSE 5 END AS code,
  CASE kind WHEN 'SPOOF_TELEPORT' THEN 90000 ELSE 20000 END AS wait FROM alerts)"""


def _feed_sql(tick_ms: int, cap: int) -> str:
    """The feed tick by tick, all stretches that are 90 s apart at once; ``shown`` is what a stretch has shown so far."""
    steps = f""", cut AS (SELECT *, at_ms - coalesce(lag(at_ms) OVER (ORDER BY id), 0) > 90000 AS new FROM coded),
cuts AS (SELECT *, sum(new::INT) OVER (ORDER BY id) AS segment FROM cut),
ticks AS (SELECT *, dense_rank() OVER (PARTITION BY segment ORDER BY at_ms // {tick_ms}) AS k FROM cuts),
run AS (SELECT DISTINCT segment, 0::BIGINT AS k, []::STRUCT(id VARCHAR, mmsi BIGINT, code INT, at_ms BIGINT)[] AS shown FROM ticks
  UNION ALL SELECT segment, k + 1, list_concat(any_value(shown), coalesce(list({{'id': id, 'mmsi': mmsi, 'code': code, 'at_ms': at_ms}}) FILTER (pick), [])) FROM (
    SELECT *, first AND row_number() OVER (PARTITION BY segment, first ORDER BY id) <= {cap} AS pick FROM (
      SELECT *, ok AND row_number() OVER (PARTITION BY segment, mmsi, code, ok ORDER BY id) = 1 AS first FROM (
        SELECT r.segment, r.k, r.shown, c.id, c.mmsi, c.code, c.at_ms, len(list_filter(r.shown, lambda z: z.mmsi = c.mmsi AND z.code = c.code AND c.at_ms - z.at_ms < c.wait)) = 0 AS ok
        FROM run r JOIN ticks c ON c.segment = r.segment AND c.k = r.k + 1))) GROUP BY segment, k),
told AS (SELECT unnest(arg_max(shown, k)).id AS id FROM run GROUP BY segment)"""
    return sql.upto("sweeps", "SELECT id, kind, severity, mmsi, at_ms FROM alerts JOIN told USING (id)", _ALL + _CODED + steps)


@query(_feed_sql(demo.SETTINGS.feed_tick_ms, demo.SETTINGS.feed_cap))
def alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the feed shows, by cooldown and cap."""
    return engine(spark, sf_dir).feed().select("id", "kind", "severity", "mmsi", "at_ms")


@query(_feed_sql(10_000, 1))
def alert_feed_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed at one alert in ten seconds, so that the cap acts and alters which alerts start a cooldown."""
    tight = replace(demo.SETTINGS, feed_cap=1, feed_tick_ms=10_000)
    return engine(spark, sf_dir).feed(tight).select("id", "kind", "severity", "mmsi", "at_ms")


@query(
    sql.upto("sweeps", "SELECT c.id, c.mmsi, c.kind, c.at_ms FROM cool JOIN coded c USING (id)",
             _ALL + _CODED + """,
cool AS (SELECT id, mmsi, code, at_ms FROM coded QUALIFY row_number() OVER (PARTITION BY mmsi, code ORDER BY id) = 1
  UNION ALL SELECT id, mmsi, code, at_ms FROM (SELECT n.id, n.mmsi, n.code, n.at_ms, row_number() OVER (PARTITION BY n.mmsi, n.code ORDER BY n.id) AS pick
    FROM cool l JOIN coded n ON n.mmsi = l.mmsi AND n.code = l.code AND n.id > l.id AND n.at_ms - l.at_ms >= n.wait) WHERE pick = 1)""")
)
def feed_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.cooled(_alerts(spark, sf_dir)).select("id", "mmsi", "kind", "at_ms")


@query(sql.upto("sweeps", "SELECT id, at_ms FROM alerts QUALIFY row_number() OVER (PARTITION BY at_ms // 1000 ORDER BY id) <= 25", _ALL))
def feed_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.capped(_alerts(spark, sf_dir)).select("id", "at_ms")


@query(sql.upto("sweeps", "SELECT id, severity FROM alerts WHERE severity IN ('HIGH', 'CRITICAL') UNION ALL SELECT id, severity FROM (SELECT id, severity FROM alerts WHERE severity NOT IN ('HIGH', 'CRITICAL') ORDER BY id DESC LIMIT 40)", _ALL))
def feed_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.retained(_alerts(spark, sf_dir)).select("id", "severity")


_WEIGHT = "CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"


@query(sql.upto("sweeps", f"SELECT mmsi, kind, severity, at_ms, lat, lon FROM alerts QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY {_WEIGHT} DESC, id DESC) = 1", _ALL))
def flag_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.flags(_alerts(spark, sf_dir))


@query(sql.upto("sweeps", f"SELECT id FROM alerts WHERE severity IN ('HIGH', 'CRITICAL') OR at_ms + 15000 >= {SNAPSHOT_MS}", _ALL))
def unexpired_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.unexpired(_alerts(spark, sf_dir), SNAPSHOT_MS, 15_000).select("id")


@query(
    sql.upto("sweeps", """SELECT count(*) FILTER (kind = 'ZONE_VIOLATION' AND severity IN ('HIGH', 'CRITICAL')) AS n_alerts, count(*) FILTER (severity = 'CRITICAL') AS n_critical,
  CASE WHEN count(*) FILTER (severity = 'CRITICAL') > 2 THEN 'High' WHEN count(*) FILTER (severity = 'CRITICAL') > 0 THEN 'Medium' ELSE 'Low' END AS threat_level, '99.9%' AS integrity FROM alerts""", _ALL)
)
def feature_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return metrics.cards(e.alerts(), e.fixes.count(), 0)


@query(
    sql.upto("sweeps", f"""SELECT id, CASE WHEN kind = 'SPOOF_TELEPORT' THEN 'implied ' || floor(round(kn * 10) / 10 + 0.5)::BIGINT || ' kn'
    WHEN kind = 'DARK_EVENT' THEN 'silent ' || floor(silence + 0.5)::BIGINT || ' s · ' || zone_id WHEN pattern IS NOT NULL THEN pattern ELSE zone_id END AS line
  FROM alerts a LEFT JOIN (SELECT kind, mmsi, at_ms, rank, seq, kn, pattern, (at_ms - ts_ms) / 1000.0 AS silence FROM found) f USING (kind, mmsi, at_ms, rank, seq)""", _ALL)
)
def detail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir).select("id", rules.detail_line("kind", "detail", "zone_id").alias("line"))


_LAST = "last AS (SELECT mmsi, lat, lon, speed_kn FROM fixes QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY ts_ms DESC, seq DESC) = 1)"


@query(
    sql.upto("events", f"""SELECT l.mmsi, lat, lon, s.score, {sql.TIER.replace("score", "s.score").replace("ELSE 'LOW' END", "WHEN s.score IS NOT NULL THEN 'LOW' END")} AS tier
FROM last l LEFT JOIN snap s USING (mmsi), (SELECT greatest(1, ceil(count(*) / 20.0))::BIGINT AS stride FROM last)
WHERE s.score IS NOT NULL OR stride = 1 OR l.mmsi % stride = 0 OR l.mmsi >= 420000000""", _AT, _LAST)
)
def positions_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    few = S.Settings(max_positions=20)
    snap = risk.snapshot(e.detected(), SNAPSHOT_MS, e.settings)
    return metrics.positions(metrics.latest(e.fixes), snap, few).select("mmsi", "lat", "lon", "score", "tier")


@query(
    sql.upto("sweeps", """SELECT 'metrics' AS type, (SELECT count(*) FROM fixes) AS ingested_total, (SELECT count(*) FROM fixes) AS processed_total, 0::BIGINT AS dropped_total,
  (SELECT count(DISTINCT mmsi) FROM fixes) AS active_vessels, (SELECT count(*) FROM alerts) AS alerts_total, (SELECT count(*) FROM snap) AS scored_vessels""", _ALL, _AT)
)
def metrics_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    found = e.detected()
    return metrics.frame(e.fixes, e.alerts(found), risk.snapshot(found, SNAPSHOT_MS, e.settings))


@query(sql.upto("fixes", "SELECT ts_ms // 3600000 * 3600000 AS tick_ms, count(*) AS n FROM fixes GROUP BY ALL"))
def ingest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rates(demo.fixes(spark, sf_dir), 3_600_000)


_HIST = "hist AS (SELECT CASE WHEN us < 1 THEN 0 ELSE least(31, floor(log2(us)))::INT END AS bucket, count(*) AS n FROM (SELECT ((seq * 7919) % 100003)::DOUBLE / 4 AS us FROM fixes) GROUP BY ALL)"


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(demo.fixes(spark, sf_dir), (F.col("seq") * 7919) % 100_003 / F.lit(4.0))


@query(sql.upto("fixes", "SELECT bucket, n FROM hist", _HIST))
def latency_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hist(spark, sf_dir)


@query(
    sql.upto("fixes", "SELECT 1.5 * pow(2.0, min(bucket) FILTER (upto >= floor(0.5 * total))) AS p50, 1.5 * pow(2.0, min(bucket) FILTER (upto >= floor(0.99 * total))) AS p99 FROM (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM hist)", _HIST)
)
def hist_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(_hist(spark, sf_dir), 50, 99)


@query(
    sql.upto("dark", f"""SELECT mmsi, ts_ms, k, round(CASE WHEN k IN (0, 30) THEN lon ELSE lon + r * sin(radians(ang)) / ({sql.M} * cos(radians(lat))) END, 6) AS x,
  round(CASE WHEN k IN (0, 30) THEN lat ELSE lat + r * cos(radians(ang)) / {sql.M} END, 6) AS y
FROM (SELECT *, trunc((100 + 0.1 * (speed_kn * {sql.NM} / 3600.0) * silence_s) * 10 + 0.5) / 10 AS r, heading_deg - 15 + 30.0 * (k - 1) / 28 AS ang FROM dark CROSS JOIN (SELECT range AS k FROM range(31)))""")
)
def cone_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    found = detectors.dark_events(e.tracked(history=False), _zones(spark), e.patrols.collect(), e.settings)
    points = feed.cones(found.withColumn("at_ms", F.col("ts_ms"))).select("mmsi", F.col("at_ms").alias("ts_ms"), F.posexplode("ring").alias("k", "p"))
    return points.select("mmsi", "ts_ms", F.col("k").cast("long").alias("k"), F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


@query(
    sql.upto("dark", "SELECT mmsi, ts_ms, patrol_id, s.p_lat, s.p_lon, lat, lon, feasible, floor(trunc(eta * 10 + 0.5) / 10 / 60 + 0.5)::INT AS eta_min FROM (SELECT * FROM solved JOIN patrols USING (patrol_id)) s",
             f"""target AS (SELECT mmsi, seq, ts_ms, speed_kn, heading_deg, lat, lon, lat + reach * cos(radians(heading_deg)) / {sql.M} AS t_lat,
  lon + reach * sin(radians(heading_deg)) / ({sql.M} * cos(radians(lat))) AS t_lon FROM (SELECT *, speed_kn * {sql.NM} / 3600.0 * silence_s AS reach FROM dark)), {_INTERCEPT}""")
)
def intercept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    found = detectors.dark_events(e.tracked(history=False), _zones(spark), e.patrols.collect(), e.settings)
    return feed.intercept_lines(found.withColumn("at_ms", F.col("ts_ms")), e.patrols).withColumnRenamed("at_ms", "ts_ms")


_CLUSTERS = """mid AS (SELECT zone_idx, (min_lon + max_lon) / 2 AS x, (min_lat + max_lat) / 2 AS y FROM zones),
reach AS (SELECT zone_idx, zone_idx AS other FROM mid UNION SELECT r.zone_idx, b.zone_idx FROM reach r JOIN mid a ON a.zone_idx = r.other JOIN mid b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 10),
clusters AS (SELECT zone_idx, min(other) AS cluster FROM reach GROUP BY ALL)"""


@query(sql.upto("dims", "SELECT zone_idx, cluster FROM clusters", _CLUSTERS))
def zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.zone_clusters(demo.zones(spark))


@query(
    sql.upto("dims", """SELECT (SELECT CASE WHEN country_code = 4 THEN 'Danish waters' ELSE zone_name END FROM zones WHERE zone_kind = 'eez' ORDER BY zone_idx LIMIT 1) AS label,
  (SELECT round((min_lat + max_lat) / 2, 6) FROM zones WHERE zone_idx = 0) AS lat, (SELECT round((min_lon + max_lon) / 2, 6) FROM zones WHERE zone_idx = 0) AS lon,
  min(min_lon) AS min_lon, min(min_lat) AS min_lat, max(max_lon) AS max_lon, max(max_lat) AS max_lat, count(*) AS zones
FROM zones JOIN clusters USING (zone_idx) GROUP BY cluster ORDER BY zones DESC, cluster LIMIT 1""", _CLUSTERS)
)
def region_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, anchor and bounds of the region that the zones are in."""
    z = demo.zones(spark)
    label = metrics.region_label(z, {S.COUNTRY["DK"]: "Danish waters"})
    anchor = dimensions.region_anchor(z).select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
    return label.crossJoin(anchor).crossJoin(metrics.view_bounds(z).drop("cluster"))


@query(
    f"""WITH {sql.WEATHER} SELECT 'weather' AS type, arg_max(wave_m, updated_ms) AS wave_height_m, max(updated_ms) AS updated_ms,
  {demo.WEATHER_START_MS + demo.WEATHER_N * demo.WEATHER_STEP_MS} - max(updated_ms) <= 1800000 AS available FROM weather"""
)
def weather_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = demo.WEATHER_START_MS + demo.WEATHER_N * demo.WEATHER_STEP_MS
    return metrics.weather_frame(dimensions.latest_weather(demo.weather(spark)), now)


@query(sql.upto("fixes", "SELECT DISTINCT mmsi, 'VESSEL-' || mmsi AS name FROM fixes WHERE mmsi % 3 = 0"))
def vessel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.names(demo.fixes(spark, sf_dir))


@query(sql.upto("fixes", "SELECT mmsi, lat, lon, speed_kn, heading_deg, flag_code, ts_ms FROM fixes QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY ts_ms DESC, seq DESC) = 1"))
def latest_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state table: each vessel's last fix."""
    return metrics.latest(demo.fixes(spark, sf_dir))


@query(sql.upto("member", "SELECT zone_id, count(*) AS fixes, count(DISTINCT mmsi) AS vessels FROM member GROUP BY ALL"))
def zone_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spatial.inside(demo.fixes(spark, sf_dir), demo.zones(spark)).select("mmsi", F.explode("zones").alias("z"))
    return rows.groupBy(F.col("z.zone_id").alias("zone_id")).agg(F.count(F.lit(1)).alias("fixes"), F.count_distinct("mmsi").alias("vessels"))


@query(
    sql.upto("sweeps", """SELECT id, a.mmsi, at_ms, kind, max(name) OVER () AS vessel_name FROM alerts a WHERE a.mmsi = (SELECT mmsi FROM alerts ORDER BY id LIMIT 1)""", _ALL)
)
def vessel_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alerts of the vessel that raised the first one, newest first."""
    found = _alerts(spark, sf_dir)
    first = found.orderBy("id").select("mmsi").first()
    return feed.vessel_alerts(found, first.mmsi if first else -1).select("id", "mmsi", "at_ms", "kind", "vessel_name")


@query()
def alert_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as the JSON frames that are sent; tested field by field."""
    return feed.envelope(_alerts(spark, sf_dir))


@query()
def positions_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One GeoJSON frame of vessels; tested field by field."""
    e = engine(spark, sf_dir)
    return metrics.positions_frame(metrics.positions(metrics.latest(e.fixes), risk.snapshot(e.detected(), SNAPSHOT_MS, e.settings)))


@query()
def fake_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.fake_frames(spark, 60)

"""A demonstration region and fixes made of the events table, the same in Spark and in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia import schema as S
from pelagia.functions import rules
from pelagia.sources import dimensions

# id, name, type, country, rings of (lon, lat)
ZONES: list[tuple[str, str, str, str | None, list[list[tuple[float, float]]]]] = [
    ("north-bank", "North Bank", "mpa", None, [[(11.16, 56.42), (11.4, 56.42), (11.4, 56.67), (11.16, 56.67), (11.16, 56.42)]]),
    ("belt", "The Belt", "ecological-zone", None, [[(10.85, 55.3), (11.12, 55.3), (11.12, 55.52), (10.85, 55.52), (10.85, 55.3)]]),
    ("home-waters", "Home Waters", "eez", "DK", [[(10.0, 54.8), (12.9, 54.8), (12.9, 57.8), (10.0, 57.8), (10.0, 54.8)]]),
    ("reef", "Reef", "coral-reef", None, [
        [(11.505, 55.505), (12.205, 55.405), (12.405, 56.005), (11.905, 56.205), (11.505, 55.505)],
        [(11.805, 55.605), (12.005, 55.605), (12.005, 55.805), (11.805, 55.805), (11.805, 55.605)],
    ]),
    ("sliver", "Sliver", "fishing-banned", None, [[(10.005, 57.101), (12.005, 57.301), (12.005, 57.305), (10.005, 57.101)]]),
    ("port", "Port", "port", "DK", [[(10.205, 55.905), (10.405, 55.905), (10.405, 56.105), (10.205, 56.105), (10.205, 55.905)]]),
    ("far", "Far Away", "mpa", None, [[(70.2, -4.5), (73.0, -4.5), (73.5, -5.5), (71.0, -8.0), (70.2, -4.5)]]),
]
PATROLS = [("north", "Cutter North", 56.9, 10.6, 26.5), ("south", "Cutter South", 55.1, 11.7, 19.0), ("east", "Launch East", 55.95, 12.6, 34.0)]
SETTINGS = S.Settings(playback_speed=600.0, as_of_ms=1_706_659_200_000)
#: Sea-state readings each 20 minutes of the month.
WEATHER_START_MS, WEATHER_STEP_MS, WEATHER_N = 1_704_067_200_000, 1_200_000, 2_200

EVENTS_AS_FIXES = {
    "seq": "event_id",
    "mmsi": "CASE WHEN user_id % 4 = 0 THEN 219000000 WHEN user_id % 4 = 1 THEN 244000000 WHEN user_id % 4 = 2 THEN 257000000 ELSE 420000000 END + user_id",
    "lat": "CASE WHEN user_id % 5 IN (0, 1) THEN 5530 + (event_id % 22) ELSE 5480 + ((event_id * 7919) % 300) END / 100.0E0",
    "lon": "CASE WHEN user_id % 5 IN (0, 1) THEN 1085 + (event_id % 27) ELSE 1000 + ((event_id * 104729) % 290) END / 100.0E0",
    "speed_kn": "CASE WHEN user_id % 5 = 0 THEN 20 + (event_id % 25) WHEN user_id % 5 = 1 THEN 20 + 60 * (event_id % 2) ELSE (event_id * 31) % 300 END / 10.0E0",
    "heading_deg": "CAST(CASE WHEN user_id % 5 = 1 THEN 90 ELSE (event_id * 37) % 360 END AS DOUBLE)",
}


def geojson() -> str:
    features = [
        {"type": "Feature", "properties": {"id": i, "name": n, "type": t} | ({"country": c} if c else {}), "geometry": {"type": "Polygon", "coordinates": rings}}
        for i, n, t, c, rings in ZONES
    ]
    return json.dumps({"type": "FeatureCollection", "features": features})


def zones(spark: SparkSession) -> DataFrame:
    return dimensions.zones_of_text(spark, geojson())


def patrols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *p) for k, p in enumerate(PATROLS)], S.PATROL)


def weather(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    return spark.range(WEATHER_N).select(((k % 7) * 0.5).alias("wave_m"), (WEATHER_START_MS + k * WEATHER_STEP_MS).alias("updated_ms"), F.lit(True).alias("ok"))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIX rows of the events table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    rows = events.select(*[F.expr(v).alias(k) for k, v in EVENTS_AS_FIXES.items()], ms.alias("ts_ms"))
    return rows.select("mmsi", "lat", "lon", "speed_kn", "heading_deg", "ts_ms", rules.flag_from_mmsi("mmsi").alias("flag_code"), "seq")


def names(fix: DataFrame) -> DataFrame:
    return fix.select("mmsi").distinct().where("mmsi % 3 = 0").select("mmsi", F.concat(F.lit("VESSEL-"), F.col("mmsi").cast("string")).alias("name"))

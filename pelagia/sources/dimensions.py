"""Zones (GeoJSON), patrols, weather readings and the region defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia import schema as S
from pelagia.functions import rules

_FEATURES = (
    "features ARRAY<STRUCT<properties: STRUCT<id: STRING, name: STRING, type: STRING, country: STRING>, "
    "geometry: STRUCT<type: STRING, coordinates: STRING>>>"
)


def zones_from(raw: DataFrame) -> DataFrame:
    """ZONE rows from a GeoJSON document parsed with the schema above.

    Polygons are kept, of multipolygons the first polygon, other geometries are passed over; an index counts what is
    kept, in file order. No usable zone is an error.
    """
    one = raw.select(F.posexplode("features").alias("pos", "f")).where(F.col("f.geometry.type").isin("Polygon", "MultiPolygon"))
    points = F.when(
        F.col("f.geometry.type") == "Polygon", F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<ARRAY<DOUBLE>>>")
    ).otherwise(F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")[0])
    text = lambda c: F.coalesce(F.col(f"f.properties.{c}"), F.lit(""))
    rows = one.select(
        "pos",
        text("id").alias("zone_id"),
        text("name").alias("zone_name"),
        text("type").alias("display_type"),
        rules.country_code(text("country")).alias("country_code"),
        F.transform(points, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))).alias("rings"),
    ).collect()  # a dimension: as large as the file of zones
    if not rows:
        raise ValueError("no zones")
    spark = raw.sparkSession
    ddl = "pos INT, zone_id STRING, zone_name STRING, display_type STRING, country_code INT, rings ARRAY<ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>>"
    kept = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(sorted(rows, key=lambda r: r.pos))], ddl)
    all_points = F.flatten("rings")
    return kept.select(
        F.col("pos").alias("zone_idx"),
        "zone_id",
        "zone_name",
        "display_type",
        rules.zone_kind("display_type").alias("zone_kind"),
        "country_code",
        F.array_min(all_points["lon"]).alias("min_lon"),
        F.array_max(all_points["lon"]).alias("max_lon"),
        F.array_min(all_points["lat"]).alias("min_lat"),
        F.array_max(all_points["lat"]).alias("max_lat"),
        "rings",
    )


def load_zones(spark: SparkSession, path: str) -> DataFrame:
    return zones_from(spark.read.schema(_FEATURES).json(path, multiLine=True))


def zones_of_text(spark: SparkSession, geojson: str) -> DataFrame:
    return zones_from(spark.createDataFrame([(geojson,)], "text STRING").select(F.from_json("text", _FEATURES).alias("j")).select("j.features"))


def zone_edges(zones: DataFrame) -> DataFrame:
    """zone_id, ring_idx, edge_idx, x1, y1, x2, y2."""
    rings = zones.select("zone_idx", "zone_id", F.posexplode("rings").alias("ring_idx", "r")).where(F.size("r") > 1)
    edges = rings.select("*", F.explode(F.sequence(F.lit(0), F.size("r") - 2)).alias("edge_idx"))
    at = lambda k, c: F.col("r")[F.col("edge_idx") + k][c]
    return edges.select(
        "zone_idx", "zone_id", "ring_idx", "edge_idx",
        at(0, "lon").alias("x1"), at(0, "lat").alias("y1"), at(1, "lon").alias("x2"), at(1, "lat").alias("y2"),
    )


def region_anchor(zones: DataFrame) -> DataFrame:
    """lat, lon: the middle of the first zone's bounds; (0, 0) if there is none."""
    first = zones.where("zone_idx = 0")
    return first.agg(
        F.coalesce(F.max((F.col("min_lat") + F.col("max_lat")) / 2), F.lit(0.0)).alias("lat"),
        F.coalesce(F.max((F.col("min_lon") + F.col("max_lon")) / 2), F.lit(0.0)).alias("lon"),
    )


def load_patrols(spark: SparkSession, path: str) -> DataFrame:
    """PATROL rows of {"patrols": [...]}; none is an error."""
    ddl = "patrols ARRAY<STRUCT<id: STRING, name: STRING, lat: DOUBLE, lon: DOUBLE, max_speed_kn: DOUBLE>>"
    rows = spark.read.schema(ddl).json(path, multiLine=True).select(F.posexplode("patrols").alias("patrol_idx", "p"))
    out = rows.select("patrol_idx", F.col("p.id").alias("patrol_id"), F.col("p.name").alias("patrol_name"), "p.lat", "p.lon", "p.max_speed_kn")
    if not out.limit(1).count():
        raise ValueError("no patrols")
    return out


def load_weather(spark: SparkSession, path: str) -> DataFrame:
    """WEATHER readings as JSON lines; a failed poll leaves no line, so the last good reading stays."""
    return spark.read.schema(S.WEATHER).json(path)


def latest_weather(readings: DataFrame) -> DataFrame:
    """The newest good reading in one row (ok false if there is none)."""
    good = readings.where("ok")
    return good.agg(F.max_by("wave_m", "updated_ms").alias("wave_m"), F.max("updated_ms").alias("updated_ms")).select(
        F.coalesce("wave_m", F.lit(0.0)).alias("wave_m"), F.coalesce("updated_ms", F.lit(0)).cast("long").alias("updated_ms"), F.col("updated_ms").isNotNull().alias("ok")
    )


@dataclass(frozen=True)
class Mode:
    """Which source runs, and over which region's files."""

    source: str
    region: str
    zones: str
    patrols: str


def choose_mode(*, fake: bool = False, scenario: str = "", csv: str = "", firehose: bool = False, zones: str = "", patrols: str = "") -> Mode:
    """Precedence fake, scenario, CSV, firehose, live; the zone and patrol files follow the region unless given."""
    source = "fake" if fake else "scenario" if scenario else "csv" if csv else "firehose" if firehose else "live"
    region = {"csv": "denmark", "live": "northsea"}.get(source, "gulf")
    if source == "scenario" and any(x in scenario for x in ("denmark", "trawling", "longlining", "seining")):
        region = "denmark"
    tail = "" if region == "gulf" else f"-{region}"
    return Mode(source, region, zones or f"zones{tail}.geojson", patrols or f"patrol{tail}.json")

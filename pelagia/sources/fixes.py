"""Sources of fixes: AIS CSV, live JSON frames, scenarios, generators. Batch and streaming share the parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia import schema as S
from pelagia.functions import rules

# Places of the columns in an AIS CSV line, and its time format.
COLUMNS = {"time": 0, "type": 1, "mmsi": 2, "lat": 3, "lon": 4, "sog": 7, "cog": 8, "heading": 9, "name": 12}
LEAST_COLUMNS = 13
TIME_FORMAT = "dd/MM/yyyy HH:mm:ss"
SCENARIO_START_MS = 1_720_000_000_000
FIXED = ["mmsi", "lat", "lon", "speed_kn", "heading_deg", "ts_ms", "flag_code", "seq"]


def _float(text: Column, default: float | None = None) -> Column:
    """Lenient number: null (or the default) where the text is none; NaN counts as none."""
    x = F.trim(text).try_cast("double")
    x = F.when(~F.isnan(x), x)
    return x if default is None else F.coalesce(x, F.lit(default))


def _degrees(first: Column, second: Column) -> Column:
    """The heading if it lies in [0, 360), else the course if that does, else 0."""
    ok = lambda x: F.when((x >= 0) & (x < 360), x)
    return F.coalesce(ok(first), ok(second), F.lit(0.0))


def _valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def single(x: Column) -> Column:
    """To single precision and back: speeds and headings are held so."""
    return x.cast("float").cast("double")


def parse_csv(lines: DataFrame, line: str = "value", seq: Column | None = None) -> DataFrame:
    """Fixes with "name" from AIS CSV lines; commas only, no quoting. Lines that are no valid Class A or B position go.

    ``seq``: arrival order; the line's place in its file and task if not given.
    """
    f = F.split(F.col(line), ",")
    cols = {k: F.get(f, F.lit(v)) for k, v in COLUMNS.items()}
    parsed = (
        lines.where(~F.col(line).startswith("#") & (F.trim(line) != ""))
        .where(F.size(f) >= LEAST_COLUMNS)
        .where(cols["type"].isin("Class A", "Class B"))
        .select(
            F.when(F.trim(cols["mmsi"]).rlike("^[0-9]{1,10}$"), F.trim(cols["mmsi"]).cast("long")).alias("mmsi"),
            _float(cols["lat"]).alias("lat"),
            _float(cols["lon"]).alias("lon"),
            _float(cols["sog"], 0.0).alias("sog"),
            single(_degrees(_float(cols["heading"], -1.0), _float(cols["cog"], 0.0))).alias("heading_deg"),
            F.unix_millis(F.try_to_timestamp(F.trim(cols["time"]), F.lit(TIME_FORMAT))).alias("ts_ms"),
            F.trim(cols["name"]).alias("name"),
            (seq if seq is not None else F.monotonically_increasing_id()).alias("seq"),
        )
        .where(F.col("mmsi").between(1, 4_294_967_295) & F.col("ts_ms").isNotNull() & _valid(F.col("lat"), F.col("lon")))
    )
    return parsed.select(
        "mmsi", "lat", "lon",
        single(F.when(F.col("sog").between(0, 102.2), F.col("sog")).otherwise(0.0)).alias("speed_kn"),
        "heading_deg", "ts_ms", rules.flag_from_mmsi("mmsi").alias("flag_code"), "seq", "name",
    )


def read_csv(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Bounded load: all valid rows, or the first ``limit`` in file order."""
    rows = parse_csv(spark.read.text(path))
    return rows.orderBy("seq").limit(limit) if limit > 0 else rows


def stream_csv(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Unbounded replay: files of a folder as they arrive."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return parse_csv(lines, seq=F.xxhash64("value"))


_LIVE = (
    "MessageType STRING, MetaData STRUCT<MMSI: LONG, ShipName: STRING, latitude: DOUBLE, longitude: DOUBLE, time_utc: STRING>, "
    "Message STRUCT<PositionReport: STRUCT<UserID: LONG, Sog: DOUBLE, Cog: DOUBLE, TrueHeading: INT, Latitude: DOUBLE, Longitude: DOUBLE>, "
    "ShipStaticData: STRUCT<UserID: LONG, Name: STRING>>"
)


def decode_live(frames: DataFrame, text: str = "value", received_ms: Column | None = None) -> DataFrame:
    """The JSON envelopes that can be read, as columns of _LIVE with received_ms."""
    at = received_ms if received_ms is not None else F.unix_millis(F.current_timestamp())
    return frames.select(F.from_json(text, _LIVE).alias("j"), at.cast("long").alias("received_ms")).select("j.*", "received_ms").where("MessageType is not null")


def normalize_live(decoded: DataFrame) -> DataFrame:
    """Fixes with "name" from position reports; the time is that of reception."""
    p, m = F.col("Message.PositionReport"), F.col("MetaData")
    mmsi = F.coalesce(F.when(p["UserID"] > 0, p["UserID"]), F.when(m["MMSI"] > 0, m["MMSI"]))
    lat, lon = F.coalesce(p["Latitude"], F.lit(0.0)), F.coalesce(p["Longitude"], F.lit(0.0))
    none = (lat == 0) & (lon == 0)
    heading = F.coalesce(p["TrueHeading"], F.lit(0)).cast("double")
    rows = decoded.where((F.col("MessageType") == "PositionReport") & p.isNotNull()).select(
        mmsi.alias("mmsi"),
        F.when(none, F.coalesce(m["latitude"], F.lit(0.0))).otherwise(lat).alias("lat"),
        F.when(none, F.coalesce(m["longitude"], F.lit(0.0))).otherwise(lon).alias("lon"),
        single(F.when((p["Sog"] >= 0) & (p["Sog"] < 102.3), p["Sog"]).otherwise(0.0)).alias("speed_kn"),
        single(_degrees(heading, F.coalesce(p["Cog"], F.lit(0.0)))).alias("heading_deg"),
        F.col("received_ms").alias("ts_ms"),
        (F.col("received_ms") if decoded.isStreaming else F.monotonically_increasing_id()).alias("seq"),
        F.nullif(F.trim(m["ShipName"]), F.lit("")).alias("name"),
    )
    good = rows.where(F.col("mmsi").isNotNull() & _valid(F.col("lat"), F.col("lon")))
    return good.select("mmsi", "lat", "lon", "speed_kn", "heading_deg", "ts_ms", rules.flag_from_mmsi("mmsi").alias("flag_code"), "seq", "name")


def live_names(decoded: DataFrame) -> DataFrame:
    """mmsi, name, received_ms from static data and from position reports' metadata."""
    s, m = F.col("Message.ShipStaticData"), F.col("MetaData")
    static = decoded.where((F.col("MessageType") == "ShipStaticData") & (s["UserID"] > 0)).select(s["UserID"].alias("mmsi"), F.trim(s["Name"]).alias("name"), "received_ms")
    from_fix = decoded.where(F.col("MessageType") == "PositionReport").select(m["MMSI"].alias("mmsi"), F.trim(m["ShipName"]).alias("name"), "received_ms")
    return static.unionByName(from_fix).where("mmsi > 0 and name <> ''")


def in_box(fixes: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """The subscription's bounding box; a plain predicate, so it is pushed into the scan."""
    return fixes.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def latest_names(names: DataFrame, order: str) -> DataFrame:
    """NAME: the last name that each vessel gave."""
    return names.where("name is not null and name <> ''").groupBy("mmsi").agg(F.max_by("name", order).alias("name"))


_SCENARIO = (
    "name STRING, description STRING, speed DOUBLE, vessels ARRAY<STRUCT<mmsi: LONG, name: STRING, flag: STRING>>, "
    "frames ARRAY<STRUCT<t_ms: LONG, mmsi: LONG, lat: DOUBLE, lon: DOUBLE, speed_kn: DOUBLE, heading_deg: DOUBLE>>"
)


def scenario_of(raw: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(fixes, names, playback speed) of one scenario document. No frames is an error; a speed of 0 or less is 1."""
    head = raw.select(F.coalesce(F.size("frames"), F.lit(0)).alias("n"), "speed").first()
    if head is None or head.n <= 0:
        raise ValueError("a scenario needs frames")
    vessels = raw.select(F.explode("vessels").alias("v")).select("v.mmsi", "v.name", rules.country_code(F.col("v.flag")).alias("flag_code"))
    frames = raw.select(F.posexplode("frames").alias("seq", "f"))
    fixes = frames.select(
        F.col("f.mmsi").alias("mmsi"), "f.lat", "f.lon", single(F.col("f.speed_kn")).alias("speed_kn"), single(F.col("f.heading_deg")).alias("heading_deg"),
        (F.lit(SCENARIO_START_MS) + F.col("f.t_ms")).alias("ts_ms"), F.col("seq").cast("long").alias("seq"),
    )
    flags = vessels.groupBy("mmsi").agg(F.last("flag_code").alias("flag_code"))
    fixes = fixes.join(flags, "mmsi", "left").withColumn("flag_code", F.coalesce("flag_code", F.lit(0))).select(*FIXED)
    return fixes, vessels.groupBy("mmsi").agg(F.last("name").alias("name")), float(head.speed) if head.speed and head.speed > 0 else 1.0


def load_scenario(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, float]:
    return scenario_of(spark.read.schema(_SCENARIO).json(path, multiLine=True))


def scenario_of_text(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, float]:
    return scenario_of(spark.createDataFrame([(text,)], "text STRING").select(F.from_json("text", _SCENARIO).alias("j")).select("j.*"))


def firehose(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """n generated fixes: every 50th from one of 64 runners that hop over a boundary each 600 s, the others from a
    static field of 100,000 vessels."""
    i = F.col("id")
    vid = i % 100_000
    run = i % 50 == 0
    nth = F.floor(i / 50)
    runner, occ = nth % 64, F.floor(nth / 64)
    base = F.lit(SCENARIO_START_MS)
    return (spark.range(0, n, 1, partitions) if partitions else spark.range(n)).select(
        F.when(run, 420_000_000 + runner).otherwise(419_000_000 + vid).cast("long").alias("mmsi"),
        F.when(run, F.when(occ % 2 == 0, 8.95).otherwise(8.85)).otherwise(8.5 + (vid * F.lit(0.000173)) % F.lit(1.4)).alias("lat"),
        F.when(run, 79.10 + runner * F.lit(0.002)).otherwise(78.5 + (vid * F.lit(0.000239)) % F.lit(2.2)).alias("lon"),
        F.when(run, 8).otherwise(2 + vid % 22).cast("double").alias("speed_kn"),
        F.when(run, 0).otherwise(vid % 360).cast("double").alias("heading_deg"),
        (base + F.when(run, occ * 600_000).otherwise(0)).cast("long").alias("ts_ms"),
        F.when(run | (vid % 3 == 0), S.COUNTRY["LK"]).otherwise(S.COUNTRY["IN"]).alias("flag_code"),
        i.alias("seq"),
    )


def runner_names(fixes: DataFrame) -> DataFrame:
    return fixes.where("mmsi >= 420000000").select("mmsi").distinct().select("mmsi", rules.runner_name("mmsi").alias("name"))


def fake_frames(spark: SparkSession, seconds: int, vessels: int = 40) -> DataFrame:
    """at_ms, frame: schema-valid metrics (each second), alerts (each third) and positions (twice a second) as JSON."""
    s = spark.range(1, seconds + 1).select(F.col("id").alias("s"))
    seq = F.floor(F.col("s") / 3)
    w = (seq % 7).cast("double")
    zero = F.lit(0.0)
    metrics = s.select(
        (F.col("s") * 1000).alias("at_ms"),
        F.to_json(F.struct(
            F.lit("metrics").alias("type"), (F.col("s") * 52_000).alias("ingested_total"), (F.col("s") * 51_950).alias("processed_total"),
            (F.col("s") * 50).alias("dropped_total"), (52_000 + w * 130).alias("rate_per_s"),
            F.struct((620 + w * 40).alias("inline_p50"), (3800 + w * 160).alias("inline_p99"), (240 + w * 30).alias("sweep_p50"), (1450 + w * 90).alias("sweep_p99")).alias("latency_us"),
            (50_000 + seq % 97).alias("active_vessels"), seq.alias("alerts_total"),
        )).alias("frame"),
    )
    kinds = F.array(*map(F.lit, (S.ZONE_VIOLATION, S.SPOOF, S.DARK)))
    kind = F.get(kinds, ((seq - 1) % 3).cast("int"))
    dark = kind == S.DARK
    lat, lon = 9.05 + (seq % 20) * 0.01, 79.10 + (seq % 25) * 0.01
    alerts = s.where(F.col("s") % 3 == 0).select(
        (F.col("s") * 1000).alias("at_ms"),
        F.to_json(F.struct(F.lit("alert").alias("type"), F.struct(
            rules.alert_id(seq).alias("id"), kind.alias("kind"), F.when(dark, "CRITICAL").otherwise("HIGH").alias("severity"),
            (419_000_000 + seq % 9000).alias("mmsi"), F.lit("SYNTHETIC VESSEL").alias("name"), (F.col("s") * 1000).alias("ts_ms"), lat.alias("lat"), lon.alias("lon"),
            F.lit("sample-zone").alias("zone_id"),
            F.struct(F.when(kind == S.SPOOF, 74.2).alias("implied_speed_kn"), F.when(dark, 68).alias("silence_s")).alias("detail"),
            F.when(dark, F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(210.0).alias("heading_deg"), F.lit(30.0).alias("spread_deg"), (1200.0 + (seq % 10) * 80).alias("radius_m"))).alias("cone"),
        ).alias("alert"))).alias("frame"),
    )
    ticks = spark.range(1, 2 * seconds + 1).select(F.col("id").alias("t")).crossJoin(F.broadcast(spark.range(vessels).select(F.col("id").cast("int").alias("v"))))
    v, heading, speed = F.col("v"), (F.col("v") * 29) % 360, 4 + F.col("v") % 16
    gone = F.col("t") * speed * 0.00004
    feature = rules.point_feature(
        419_000_000 + v, 8.8 + (v % 10) * 0.05 + gone * F.cos(F.radians(heading)), 79.0 + (v % 13) * 0.04 + gone * F.sin(F.radians(heading)), speed.cast("double"), heading.cast("double") + zero
    )
    positions = ticks.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("v", feature.alias("f")))).alias("fs")).select(
        (F.col("t") * 500).alias("at_ms"),
        F.to_json(F.struct(F.lit("positions").alias("type"), F.struct(F.lit("FeatureCollection").alias("type"), F.col("fs.f").alias("features")).alias("fc"))).alias("frame"),
    )
    return metrics.unionByName(alerts).unionByName(positions)


def live_schema() -> T.StructType:
    return T.StructType.fromDDL(_LIVE)

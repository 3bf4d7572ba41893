"""Counters, rates, latency histograms, position frames, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia import schema as S
from pelagia.functions import rules


def latest(fixes: DataFrame) -> DataFrame:
    """Each vessel's last fix."""
    cols = [c for c in ("lat", "lon", "speed_kn", "heading_deg", "flag_code", "ts_ms") if c in fixes.columns]
    return fixes.groupBy("mmsi").agg(F.max_by(F.struct(*cols), F.struct("ts_ms", "seq")).alias("v")).select("mmsi", "v.*")


def rates(fixes: DataFrame, tick_ms: int = 1_000, at: str = "ts_ms") -> DataFrame:
    """tick_ms, n: fixes per second."""
    return fixes.groupBy((F.floor(F.col(at) / tick_ms) * tick_ms).cast("long").alias("tick_ms")).agg(F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, us: Column | str) -> DataFrame:
    """bucket, n: how many latencies lie in each power of two."""
    return rows.groupBy(rules.hist_bucket(us).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(hist: DataFrame, *ps: int) -> DataFrame:
    """One row: p<k> is the middle of the bucket by which so much is reached; 0 for an empty histogram. 32 rows at most."""
    upto = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    seen = hist.select("bucket", "n", upto.alias("upto")).crossJoin(hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")))
    # a target of 0 is reached in the first bucket, counted or not
    def of(p: int) -> Column:
        target = F.floor(F.lit(p / 100.0) * F.col("total"))
        first = F.min(F.when(F.col("upto") >= target, F.col("bucket")))
        return F.coalesce(F.when(F.max(target) == 0, 1.5).otherwise(1.5 * F.pow(F.lit(2.0), first)), F.lit(0.0)).alias(f"p{p}")

    return seen.agg(*[of(p) for p in ps])


def frame(fixes: DataFrame, alerts: DataFrame, scored: DataFrame, dropped: int = 0) -> DataFrame:
    """The metrics frame's counters in one row. Rates and latencies come from the run, not from the data."""
    a = fixes.agg(F.count(F.lit(1)).alias("ingested_total"), F.count_distinct("mmsi").alias("active_vessels"))
    b = alerts.agg(F.count(F.lit(1)).alias("alerts_total"))
    c = scored.agg(F.count(F.lit(1)).alias("scored_vessels"))
    return a.crossJoin(b).crossJoin(c).select(
        F.lit("metrics").alias("type"), "ingested_total", F.col("ingested_total").alias("processed_total"), F.lit(dropped).cast("long").alias("dropped_total"),
        "active_vessels", "alerts_total", "scored_vessels",
    )


def positions(last: DataFrame, scored: DataFrame, settings: S.Settings = S.Settings()) -> DataFrame:
    """Vessels to draw: all while they are few, else every stride-th by number, and all scored ones and runners."""
    n = last.agg(F.count(F.lit(1)).alias("n"))
    stride = F.when(F.col("n") > settings.max_positions, F.ceil(F.col("n") / settings.max_positions)).otherwise(1).cast("long")
    marked = last.join(scored.select("mmsi", "score", "tier", "factors"), "mmsi", "left").crossJoin(F.broadcast(n.select(stride.alias("stride"))))
    keep = F.col("score").isNotNull() | (F.col("stride") == 1) | (F.col("mmsi") % F.col("stride") == 0) | (F.col("mmsi") >= 420_000_000)
    return marked.where(keep).drop("stride")


def positions_frame(drawn: DataFrame, per_frame: int = 10_000) -> DataFrame:
    """GeoJSON frames of the drawn vessels: one while they are at most ``per_frame``. Sampling thins out only vessels
    without a score, so there may be more; they go in as many frames, by vessel, so that no frame grows with the fleet."""
    feature = rules.point_feature(
        "mmsi", "lat", "lon", "speed_kn", "heading_deg",
        risk_score=F.when(F.col("score") != 0, F.col("score")), risk_tier=F.col("tier"), factors=F.when(F.size("factors") > 0, F.col("factors")),
    )
    parts = drawn.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / per_frame)).cast("int").alias("parts"))
    each = drawn.select("mmsi", feature.alias("f")).crossJoin(F.broadcast(parts)).withColumn("part", F.pmod(F.xxhash64("mmsi"), F.col("parts")))
    all_features = F.sort_array(F.collect_list(F.struct("mmsi", "f")))
    return each.groupBy("part").agg(all_features.alias("fs")).select(
        F.to_json(F.struct(F.lit("positions").alias("type"), F.struct(F.lit("FeatureCollection").alias("type"), F.col("fs.f").alias("features")).alias("fc"))).alias("frame")
    )


def weather_frame(latest_reading: DataFrame, now_ms: int, settings: S.Settings = S.Settings()) -> DataFrame:
    fresh = F.col("ok") & (F.lit(now_ms) - F.col("updated_ms") <= settings.weather_stale_ms)
    return latest_reading.select(F.lit("weather").alias("type"), F.col("wave_m").alias("wave_height_m"), "updated_ms", fresh.alias("available"))


def cards(alerts: DataFrame, processed: int | Column, dropped: int | Column) -> DataFrame:
    """The dashboard's cards: alerts of the alert tab, critical alerts, threat level, integrity."""
    p, d = (x if isinstance(x, Column) else F.lit(x) for x in (processed, dropped))
    lost = F.when(p > 0, d * 100.0 / (p + d)).otherwise(0.0)
    critical = F.col("n_critical")
    counts = alerts.agg(F.count_if(rules.is_alert_tab()).alias("n_alerts"), F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"))
    return counts.select(
        "n_alerts", "n_critical",
        F.when(critical > 2, "High").when(critical > 0, "Medium").otherwise("Low").alias("threat_level"),
        F.when(lost < 0.1, "99.9%").when(lost < 1, F.format_string("%.1f%%", 100 - lost)).otherwise(F.format_string("%.0f%%", 100 - lost)).alias("integrity"),
    )


def zone_clusters(zones: DataFrame, reach_deg: float = 10.0) -> DataFrame:
    """Zones whose bounds' middles chain within ``reach_deg``: zone_idx, cluster (its lowest index). Zones are a dimension."""
    mid = zones.select("zone_idx", ((F.col("min_lon") + F.col("max_lon")) / 2).alias("x"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("y"))
    spark = zones.sparkSession
    rows = {r.zone_idx: (r.x, r.y) for r in mid.collect()}
    label = {i: i for i in rows}
    moved = True
    while moved:
        moved = False
        for i, (a, b) in rows.items():
            for j, (c, d) in rows.items():
                if label[j] < label[i] and ((a - c) ** 2 + (b - d) ** 2) ** 0.5 <= reach_deg:
                    label[i], moved = label[j], True
    return spark.createDataFrame(sorted(label.items()), "zone_idx INT, cluster INT")


def view_bounds(zones: DataFrame) -> DataFrame:
    """The bounds of the largest cluster of zones, the first of equally large ones."""
    marked = zones.join(F.broadcast(zone_clusters(zones)), "zone_idx")
    each = marked.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("zones"), F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat")
    )
    return each.orderBy(F.desc("zones"), "cluster").limit(1)


def region_label(zones: DataFrame, labels: dict[int, str]) -> DataFrame:
    """The first economic zone's country, as a label; its own name where there is no label for it."""
    out = F.col("zone_name")
    for k, v in labels.items():
        out = F.when(F.col("country_code") == k, v).otherwise(out)
    return zones.where(F.col("zone_kind") == S.EEZ).agg(F.min_by(out, "zone_idx").alias("label"))

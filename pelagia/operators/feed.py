"""The alert feed: a cooldown per vessel and kind, a cap per second, retention, overlays, expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pelagia import schema as S
from pelagia.functions import rules
from pelagia.operators import tracks

ORDER = ("at_ms", "rank", "mmsi", "seq", "zone_id")
#: Longer than any cooldown: after this much silence the feed remembers nothing.
FORGETS_MS = 90_000


def cooled(alerts: DataFrame) -> DataFrame:
    """Alerts at least a cooldown after the last one shown of the same vessel and kind code; no cap."""
    coded = alerts.withColumn("code", rules.feed_code("kind"))
    order = [c for c in ORDER if c not in ("mmsi", "code")]
    return tracks.spaced(coded, ["mmsi", "code"], order, "at_ms", rules.feed_cooldown_ms("kind"), strict=False)


def capped(alerts: DataFrame, settings: S.Settings = S.Settings()) -> DataFrame:
    """At most ``feed_cap`` alerts of each tick, in order."""
    tick = F.floor(F.col("at_ms") / settings.feed_tick_ms)
    n = F.row_number().over(Window.partitionBy(tick).orderBy(*ORDER))
    return alerts.withColumn("_n", n).where(F.col("_n") <= settings.feed_cap).drop("_n")


def segments(alerts: DataFrame) -> DataFrame:
    """minute, segment: stretches that are two whole minutes or more without an alert apart.

    Nothing that the feed remembers lasts that long, so segments are independent. What is ordered in one task are
    the minutes that have alerts, not the alerts.
    """
    active = alerts.select(_minute().alias("minute")).distinct()
    w = Window.orderBy("minute")
    far = F.col("minute") - F.lag("minute", 1, None).over(w) > 2
    return active.withColumn("new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("segment", F.sum("new").over(w)).select("minute", "segment")


def _minute() -> Column:
    return F.floor(F.col("at_ms") / 60_000)


def feed(alerts: DataFrame, settings: S.Settings = S.Settings(), keep: Callable[[str, DataFrame], DataFrame] = lambda name, rows: rows) -> DataFrame:
    """What the feed shows, exactly: an alert in cooldown is passed over, one beyond the tick's cap too, and only shown
    alerts start a cooldown.

    Cooldowns of vessels and kinds are independent of each other; only the cap couples them. So all alerts are spaced
    in parallel first. Where no tick of a segment has more than the cap left, that is the answer: the cap never acts.
    Only segments with a fuller tick are folded in order, each in a stream of sorted rows. The alerts and those that are
    spaced are read more than once: ``keep`` may store them.
    """
    alerts = keep("numbered", alerts)
    cap, tick = settings.feed_cap, F.floor(F.col("at_ms") / settings.feed_tick_ms)
    free = keep("spaced", cooled(alerts).drop("code"))
    over = free.groupBy(tick.alias("tick")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
    full = over.select(F.floor(F.col("tick") * settings.feed_tick_ms / 60_000).alias("minute")).distinct()
    where = segments(alerts)
    coupled = where.join(where.join(full, "minute", "left_semi").select("segment").distinct(), "segment")
    rest = free.withColumn("minute", _minute()).join(coupled.select("minute"), "minute", "left_anti").drop("minute")
    return rest.unionByName(_folded(alerts.withColumn("minute", _minute()).join(coupled, "minute").drop("minute"), alerts.schema, settings))


def _folded(alerts: DataFrame, out: StructType, settings: S.Settings) -> DataFrame:
    """The feed over each "segment" as a fold over its sorted rows. The state is the last time shown per vessel and kind
    code, dropped once too old."""
    cap, tick_ms = settings.feed_cap, settings.feed_tick_ms
    coded = alerts.withColumn("_code", rules.feed_code("kind")).withColumn("_wait", rules.feed_cooldown_ms("kind"))
    sorted_rows = coded.repartition("segment").sortWithinPartitions("segment", *ORDER)
    places = [sorted_rows.columns.index(c) for c in ("segment", "at_ms", "mmsi", "_code", "_wait")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, tick, sent, shown = None, None, 0, {}
        for batch in batches:
            keep = []
            for s, at, mmsi, code, wait in zip(*(batch.column(p).to_pylist() for p in places), strict=True):
                if s != segment:
                    segment, tick, sent, shown = s, None, 0, {}
                if at // tick_ms != tick:
                    tick, sent = at // tick_ms, 0
                    if len(shown) > 100_000:
                        shown = {k: v for k, v in shown.items() if at - v < FORGETS_MS}
                last = shown.get((mmsi, code))
                ok = (last is None or at - last >= wait) and sent < cap
                if ok:
                    shown[mmsi, code] = at
                    sent += 1
                keep.append(ok)
            yield batch.filter(pa.array(keep, pa.bool_())).select(out.names)

    return sorted_rows.mapInArrow(run, out)


def numbered(alerts: DataFrame) -> DataFrame:
    """alerts with "id": a-000001 and on, in order of time, rank, vessel and zone.

    Numbers are offsets of hours plus ranks within an hour, so no task orders all alerts.
    """
    hour = F.floor(F.col("at_ms") / 3_600_000)
    coded = alerts.withColumn("_hour", hour)
    counts = coded.groupBy("_hour").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.withColumn("_ahead", F.sum("_n").over(Window.orderBy("_hour")) - F.col("_n")).drop("_n")
    n = F.row_number().over(Window.partitionBy("_hour").orderBy(*ORDER))
    return coded.withColumn("_k", n).join(ahead, "_hour").withColumn("id", rules.alert_id(F.col("_ahead") + F.col("_k"))).drop("_hour", "_k", "_ahead")


def retained(shown: DataFrame, others: int = 40) -> DataFrame:
    """The dashboard's list: all HIGH and CRITICAL alerts and the newest 40 others."""
    major = rules.is_major()
    keep = shown.where(major)
    rest = shown.where(~major).orderBy(*[F.desc(c) for c in ORDER]).limit(others)
    return keep.unionByName(rest)


def flags(shown: DataFrame) -> DataFrame:
    """Per vessel the alert that its map mark shows: the latest of those as severe as any before them."""
    weight = rules.severity_weight("severity")
    return shown.groupBy("mmsi").agg(F.max_by(F.struct("kind", "severity", "at_ms", "lat", "lon"), F.struct(weight.alias("w"), *ORDER)).alias("a")).select("mmsi", "a.*")


def unexpired(shown: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """HIGH and CRITICAL stay; others for their time to live (15 s for cones, 9 s for marks)."""
    return shown.where(rules.is_major() | (F.col("at_ms") + ttl_ms >= now_ms))


def vessel_alerts(shown: DataFrame, mmsi: int) -> DataFrame:
    """A vessel's alerts, newest first, each with the name that its newest alert has."""
    own = shown.where(F.col("mmsi") == mmsi)
    newest = own.agg(F.max_by("name", F.struct("at_ms", "rank", "seq")).alias("vessel_name"))
    return own.crossJoin(F.broadcast(newest)).orderBy(F.desc("at_ms"), F.desc("rank"), F.desc("seq"))


def envelope(alerts: DataFrame) -> DataFrame:
    """at_ms, frame: alerts as JSON; what is null, and a score of 0 or no factors, is left out."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    body = F.struct(
        "id", "kind", "severity", "mmsi", F.coalesce("name", F.lit("")).alias("name"), "ts_ms", "lat", "lon", F.coalesce("zone_id", F.lit("")).alias("zone_id"),
        "detail", "cone", some("intercepts").alias("intercepts"), F.when(F.col("score") != 0, F.col("score")).alias("score"), some("factors").alias("factors"),
    )
    return alerts.select("at_ms", F.to_json(F.struct(F.lit("alert").alias("type"), body.alias("alert"))).alias("frame"))


def fan(lat: Column, lon: Column, heading: Column, spread: Column, radius: Column, steps: int = 28) -> Column:
    """A cone's ring of [lon, lat]: the origin, an arc in 28 steps, the origin."""
    from pelagia.functions import geo

    def at(i: Column) -> Column:
        y, x = geo.dead_reckon(lat, lon, heading - spread / 2 + spread * i / steps, radius)
        return F.array(x, y)

    origin = F.array(F.array(lon, lat))
    return F.concat(origin, F.transform(F.sequence(F.lit(0), F.lit(steps)), at), origin)


def cones(alerts: DataFrame) -> DataFrame:
    c = F.col("cone")
    return alerts.where("cone is not null").select("mmsi", "at_ms", fan(c["lat"], c["lon"], c["heading_deg"], c["spread_deg"], c["radius_m"]).alias("ring"))


def intercept_lines(alerts: DataFrame, patrols: DataFrame) -> DataFrame:
    """A row per dark alert and patrol: the line from the patrol to the cone's origin, feasible, minutes to go."""
    each = alerts.where("cone is not null").select("mmsi", "at_ms", "cone", F.explode("intercepts").alias("i"))
    p = patrols.select("patrol_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    return each.join(F.broadcast(p), F.col("i.patrol_id") == F.col("patrol_id")).select(
        "mmsi", "at_ms", "patrol_id", "p_lat", "p_lon", F.col("cone.lat").alias("lat"), F.col("cone.lon").alias("lon"),
        "i.feasible", F.floor(F.col("i.eta_s") / 60 + 0.5).cast("int").alias("eta_min"),
    )

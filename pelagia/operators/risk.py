"""Risk: a decayed 0-100 score per vessel from its alerts, tiers, and the alert when a vessel crosses into HIGH."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia import schema as S
from pelagia.functions import rules
from pelagia.operators import tracks

# Points per factor.
ZONE_POINTS, SPOOF_POINTS, FISH_POINTS, DARK_FIRST, DARK_MORE = 90, 15, 20, 15, 10
LABELS = {
    "ZONE": "Protected-zone violation", "SPOOF": "Position spoof / teleport", "FISHING": "Fishing behavior inside protected zone",
    "DARK": "Went dark near protected zone", "DARKS": "Repeated dark events near protected zone",
}


def with_state(events: DataFrame, settings: S.Settings = S.Settings()) -> DataFrame:
    """events (mmsi, kind, at_ms, rank, seq) with "state": last time of each factor and the last 16 dark times, this event included."""
    order = ("at_ms", "rank", "seq")
    dark = F.col("kind") == S.DARK
    recent = F.collect_list("at_ms").over(Window.partitionBy("mmsi", "_dark").orderBy(*order).rowsBetween(1 - settings.max_dark, 0))
    run = Window.partitionBy("mmsi").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    of = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("at_ms"))).over(run)
    # dealt by vessel once: both windows below are content with that
    return (
        tracks.dealt(events, "mmsi")
        .withColumn("_dark", dark)
        .withColumn("_recent", F.when(F.col("_dark"), recent))
        .withColumn(
            "state",
            F.struct(
                of(S.ZONE_VIOLATION).alias("zone_ms"), of(S.SPOOF).alias("spoof_ms"), of(*S.FISHING_KINDS).alias("fish_ms"),
                F.last("_recent", ignorenulls=True).over(run).alias("dark_ms"),
            ),
        )
        .drop("_dark", "_recent")
    )


def factors(state: Column | str, now: Column, settings: S.Settings = S.Settings()) -> Column:
    """What a vessel's state counts for at a time, in the order ZONE, DARK, SPOOF, FISHING; factors of no points left out."""
    s = F.col(state) if isinstance(state, str) else state

    def factor(code: str, label: Column, base, at: Column) -> Column:
        p = rules.points(base, now - at, settings.half_life_ms)
        known = at.isNotNull() & (at != 0) & (now - at <= settings.window_ms)
        return F.when(known & (p > 0), F.struct(F.lit(code).alias("code"), label.alias("label"), p.alias("points"), at.alias("ts_ms")))

    darks = F.filter(F.coalesce(s["dark_ms"], F.array().cast("array<long>")), lambda t: now - t <= settings.window_ms)
    n = F.size(darks)
    return F.array_compact(
        F.array(
            factor("ZONE", F.lit(LABELS["ZONE"]), F.lit(ZONE_POINTS), s["zone_ms"]),
            factor("DARK", F.when(n > 1, LABELS["DARKS"]).otherwise(LABELS["DARK"]), DARK_FIRST + DARK_MORE * (n - 1), F.when(n > 0, F.try_element_at(darks, F.lit(-1)))),
            factor("SPOOF", F.lit(LABELS["SPOOF"]), F.lit(SPOOF_POINTS), s["spoof_ms"]),
            factor("FISHING", F.lit(LABELS["FISHING"]), F.lit(FISH_POINTS), s["fish_ms"]),
        )
    ).cast(S.FACTORS)


def total(found: Column) -> Column:
    return F.least(F.lit(100), F.aggregate(found, F.lit(0), lambda a, f: a + f["points"]))


def scored(events: DataFrame, settings: S.Settings = S.Settings()) -> DataFrame:
    """events with "state", "factors" and "score", each as of the event. Events that have their state keep it."""
    rows = _stated(events, settings).withColumn("factors", factors("state", F.col("at_ms"), settings))
    return rows.withColumn("score", total(F.col("factors")))


def _stated(events: DataFrame, settings: S.Settings) -> DataFrame:
    return events if "state" in events.columns else with_state(events, settings)


def with_severity(alerts: DataFrame) -> DataFrame:
    """HIGH or CRITICAL by score; fishing is MEDIUM below CRITICAL."""
    by_score = rules.severity("score")
    fishing = F.col("kind").isin(*S.FISHING_KINDS)
    return alerts.withColumn("severity", F.when(fishing & (by_score != "CRITICAL"), "MEDIUM").otherwise(by_score))


def sweeps(events: DataFrame, settings: S.Settings = S.Settings()) -> DataFrame:
    """A row per vessel and sweep with news: mmsi, sweep_ms, factors, score, tier, tier_before (null on its first), and
    where the events have them "fix", the last fix (ts_ms, seq, lat, lon) that an event of the sweep names.

    Between events a score only falls, so a tier can rise at the first sweep after an event only.
    """
    tick = settings.sweep_ms
    at = (F.ceil(F.col("at_ms") / tick) * tick).cast("long")
    rows = _stated(events, settings).withColumn("sweep_ms", at)
    placed = {"ts_ms", "seq", "lat", "lon"} <= set(events.columns)
    also = [F.max(F.struct("ts_ms", "seq", "lat", "lon")).alias("fix")] if placed else []
    last = rows.groupBy("mmsi", "sweep_ms").agg(F.max_by("state", F.struct("at_ms", "rank", "seq")).alias("state"), *also)
    before = F.lag("state").over(Window.partitionBy("mmsi").orderBy("sweep_ms"))
    found = last.withColumn("was", before).withColumn("factors", factors("state", F.col("sweep_ms"), settings))
    earlier = total(factors("was", F.col("sweep_ms") - tick, settings))
    return found.withColumn("score", total(F.col("factors"))).select(
        "mmsi", "sweep_ms", "factors", "score", rules.tier("score").alias("tier"), F.when(F.col("was").isNotNull(), rules.tier(earlier)).alias("tier_before"),
        *(["fix"] if placed else []),
    )


def suspected(events: DataFrame, settings: S.Settings = S.Settings()) -> DataFrame:
    """Sweeps at which a vessel rises to HIGH or beyond."""
    return sweeps(events, settings).where(rules.crossed_up_to("tier_before", "tier", "HIGH"))


def last_positions(fixes: DataFrame, swept: DataFrame, settings: S.Settings = S.Settings()) -> DataFrame:
    """``swept`` (rows of ``sweeps`` with "fix") with lat and lon of the vessel's last fix up to the sweep.

    A sweep has an event in the tick before it. An entry, jump or gear is told at a fix, and a dark vessel has none
    between its last fix and being told, so the last fix is the latest of the tick or, if the tick has none, the one
    that the event names. The join is by vessel and tick: it meets the fixes of one tick, not a track.
    """
    tick = settings.sweep_ms
    at = (F.ceil(F.col("ts_ms") / tick) * tick).cast("long")
    own = [c for c in swept.columns if c not in ("mmsi", "sweep_ms", "fix")]
    seen = fixes.select("mmsi", at.alias("sweep_ms"), F.struct("ts_ms", "seq", "lat", "lon").alias("seen"))
    met = swept.join(seen, ["mmsi", "sweep_ms"], "left").groupBy("mmsi", "sweep_ms")
    found = met.agg(F.greatest(F.max("seen"), F.max("fix")).alias("p"), *[F.first(c).alias(c) for c in own])
    return found.select("mmsi", "sweep_ms", *own, "p.lat", "p.lon")


def snapshot(events: DataFrame, now_ms: int, settings: S.Settings = S.Settings()) -> DataFrame:
    """mmsi, factors, score, tier of every vessel with events up to a time."""
    rows = _stated(events.where(F.col("at_ms") <= now_ms), settings)
    last = rows.groupBy("mmsi").agg(F.max_by("state", F.struct("at_ms", "rank", "seq")).alias("state"))
    found = last.withColumn("factors", factors("state", F.lit(now_ms), settings)).withColumn("score", total(F.col("factors")))
    return found.select("mmsi", "factors", "score", rules.tier("score").alias("tier"))

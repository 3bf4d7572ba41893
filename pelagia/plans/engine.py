"""The whole engine in batch: fixes, zones and patrols in, alerts out.

The plan is one exchange of the fixes by vessel and one sort: zones are found by
an expression before it, and previous fix, next fix and ring of fixes are window
functions on the same ordering. Alerts, which are few, are scored after that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pelagia import schema as S
from pelagia import stored
from pelagia.functions import rules
from pelagia.operators import detectors, feed, risk, spatial, tracks


@dataclass
class Engine:
    """Inputs of a run. ``names`` and ``weather`` may be left out."""

    fixes: DataFrame
    zones: DataFrame
    patrols: DataFrame | None = None
    names: DataFrame | None = None
    weather: DataFrame | None = None
    settings: S.Settings = S.Settings()
    _kept: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    _zones: list[Row] | None = None

    def tracked(self, history: bool = True) -> DataFrame:
        """Fixes with their zones, previous fix, next time and ring."""
        few = self._zone_rows()
        rows = tracks.with_previous(spatial.inside(self.fixes, self.zones, self.settings, few if len(few) <= self.settings.inline_zones else []))
        return tracks.with_history(rows, self.settings) if history else rows

    def _zone_rows(self) -> list[Row]:
        """The zones, read once, if there are at most ``Settings.near_zones``, else none."""
        if self._zones is None:
            self._zones = spatial.zone_rows(self.zones, max(self.settings.near_zones, self.settings.inline_zones))
        return self._zones

    def found(self) -> DataFrame:
        """ALERTS of all detectors before fishing is spaced, in one pass over the fixes. With more than
        ``Settings.near_zones`` zones darkness takes a pass of its own, in which zones meet silent fixes by grid cells."""
        patrols = patrol_rows(self.patrols)
        zones = self._zone_rows()
        rows = detectors.all_at_once(self.tracked(), zones, patrols, self.settings)
        if not zones:
            rows = rows.unionByName(detectors.dark_events_by_cells(self.tracked(history=False), self.zones, patrols, self.settings))
        return rows

    def unscored(self) -> DataFrame:
        """ALERTS of all detectors, fishing spaced; what ``found`` gives is written first."""
        return detectors.spaced_fishing(self._keep("found", self.found), self.settings)

    def detected(self) -> DataFrame:
        """ALERTS of all detectors, unscored, with the risk state as of each. Found at the first call and written to the
        shared folder, as scores, sweeps and numbers each read them; alerts are few beside the fixes."""
        return self._keep("detected", lambda: risk.with_state(self.unscored(), self.settings))

    def _keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = stored.written(make(), name)
        return self._kept[name][0]

    def close(self) -> None:
        """Delete what is written."""
        for _, path in self._kept.values():
            stored.drop(path)
        self._kept.clear()

    def scored(self, detected: DataFrame | None = None) -> DataFrame:
        """Alerts with score, factors and severity, weather applied."""
        rows = risk.with_severity(risk.scored(self.detected() if detected is None else detected, self.settings)).drop("state")
        # factors travel with tier alerts only
        return with_weather(rows, self.weather, self.settings).withColumn("factors", F.lit(None).cast(S.FACTORS))

    def suspected(self, detected: DataFrame) -> DataFrame:
        rows = risk.last_positions(self.fixes, risk.suspected(detected, self.settings), self.settings)
        return detectors._alerts(
            rows, ("score", "factors"), kind=F.lit(S.SUSPECTED), at_ms=F.col("sweep_ms"), ts_ms=F.col("sweep_ms"), rank=F.lit(4_000_000), seq=F.lit(0),
            detail=detectors._detail(tier=F.col("tier")),
        ).withColumn("severity", F.lit("HIGH"))

    def alerts(self, detected: DataFrame | None = None) -> DataFrame:
        """All alerts, numbered and named. Pass what ``detected`` gave if it is written somewhere, to run that once."""
        found = self.detected() if detected is None else detected

        def named() -> DataFrame:
            every = self.scored(found).unionByName(self.suspected(found))
            if self.names is None:
                return every.withColumn("name", F.lit(""))
            return every.join(self.names.select("mmsi", "name"), "mmsi", "left").withColumn("name", F.coalesce("name", F.lit("")))

        # numbers take counts first, then rows; without a written copy both would score all over again
        return feed.numbered(self._keep("named", named) if detected is None else named())

    def feed(self, settings: S.Settings | None = None) -> DataFrame:
        """What the feed shows of all alerts."""
        return feed.feed(self.alerts(), settings or self.settings, lambda name, rows: self._keep(name, lambda: rows))


def patrol_rows(patrols: DataFrame | None, most: int = 100_000) -> list[Row]:
    """All patrols. Every dark alert carries an intercept per patrol, so a fleet is as small as a row can be; more than
    ``most`` are an error, not a cut."""
    rows = [] if patrols is None else patrols.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} patrols")
    return rows


def with_weather(alerts: DataFrame, readings: DataFrame | None, settings: S.Settings = S.Settings()) -> DataFrame:
    """Fishing alerts with the sea state as of their time; a sea that explains the track keeps them at MEDIUM.

    A reading counts for ``weather_stale_ms``, so an alert meets those of its own and the previous stretch of that
    length: an equi-join on stretches, whose readings are gathered into one sorted row each.
    """
    if readings is None:
        return alerts
    span = settings.weather_stale_ms
    stretch = lambda c: F.floor(F.col(c) / span)
    good = readings.where("ok").select("updated_ms", "wave_m", F.explode(F.array(stretch("updated_ms"), stretch("updated_ms") + 1)).alias("_stretch"))
    log = good.groupBy("_stretch").agg(F.array_sort(F.collect_list(F.struct("updated_ms", "wave_m"))).alias("_log"))
    rows = alerts.withColumn("_stretch", stretch("at_ms")).join(log, "_stretch", "left")
    fresh = F.filter("_log", lambda r: (r["updated_ms"] <= F.col("at_ms")) & (F.col("at_ms") - r["updated_ms"] <= span))
    wave = F.when(F.col("kind").isin(*S.FISHING_KINDS), F.try_element_at(fresh, F.lit(-1))["wave_m"])
    rows = rows.withColumn("_wave", wave)
    said = F.nullif(rules.weather_confidence("kind", "_wave"), F.lit(""))
    detail = F.col("detail").withField("sea_state_m", rules.round1_away("_wave")).withField("weather_confidence", F.when(F.col("_wave").isNotNull(), said))
    rows = rows.withColumn("detail", detail).withColumn("severity", F.when(F.col("detail.weather_confidence") == "LOW", "MEDIUM").otherwise(F.col("severity")))
    return rows.drop("_log", "_wave", "_stretch")

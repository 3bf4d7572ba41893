"""Alerts from a stream of fixes: keyed state per vessel, event-time timers for silence and sweeps.

Rows of a vessel are handled in order of (ts_ms, seq) within a micro-batch. A
timer stands for what happens if nothing comes: it fires when the watermark
passes the moment a vessel goes dark, or its pending sweep. Rows at or behind
the watermark are late and dropped by the operator; ``delay`` says how long to
wait for them. State is kept for ever unless ``forget_s`` gives a time to live.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pelagia import schema as S
from pelagia.operators import spatial
from pelagia.plans.engine import patrol_rows
from pelagia.streaming.machine import Area, Factors, Machine, Vessel, areas

ALERTS = (
    "mmsi LONG, kind STRING, severity STRING, at_ms LONG, ts_ms LONG, lat DOUBLE, lon DOUBLE, zone_id STRING, score INT, "
    f"detail STRUCT<zone_kind: STRING, implied_speed_kn: DOUBLE, pattern: STRING, silence_s: DOUBLE, tier: STRING>, cone {S.CONE}, intercepts {S.INTERCEPTS}"
)

#: What a worker may hold.
MOST_ZONES = 100_000


def to_json(v: Vessel) -> str:
    f = lambda x: None if x is None else [x.zone, x.spoof, x.fish, x.dark]
    return json.dumps([v.fix, v.ring, v.last_fishing, v.told_dark, f(v.now), f(v.was), v.sweep])


def from_json(text: str) -> Vessel:
    fix, ring, last, told, now, was, sweep = json.loads(text)
    return Vessel(tuple(fix) if fix else None, [tuple(r) for r in ring], last, told, Factors(*now), Factors(*was) if was else None, sweep)


class Watch(StatefulProcessor):
    """Runs the machine of one vessel on its rows and timers."""

    def __init__(self, zones: list[Area], patrols: list[tuple[str, float, float, float]], settings: S.Settings, forget_s: int | None) -> None:
        self.machine, self.forget_s = Machine(zones, patrols, settings), forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("vessel", "json STRING", self.forget_s * 1000 if self.forget_s else None)

    def _load(self) -> Vessel:
        return from_json(self.state.get()[0]) if self.state.exists() else Vessel()

    def _save(self, v: Vessel, now: int) -> None:
        """Keep the state, and one timer for whatever is due next."""
        self.state.update((to_json(v),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        due = [t + 1 for t in (self.machine.detect_ms(v), v.sweep or None) if t is not None]
        if due:
            self.handle.registerTimer(max(min(due), now + 1))

    def _rows(self, key, alerts: list[dict]) -> Iterator[Row]:
        for a in alerts:
            detail = Row(zone_kind=a.get("zone_kind"), implied_speed_kn=a.get("implied_speed_kn"), pattern=a.get("pattern"), silence_s=a.get("silence_s"), tier=a.get("tier"))
            yield Row(
                mmsi=key[0], kind=a["kind"], severity=a["severity"], at_ms=a["at_ms"], ts_ms=a["ts_ms"], lat=a["lat"], lon=a["lon"], zone_id=a.get("zone_id", ""),
                score=a["score"], detail=detail, cone=a.get("cone"), intercepts=a.get("intercepts"),
            )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        v, out = self._load(), []
        for r in sorted(rows, key=lambda r: (r.ts_ms, r.seq)):
            out += self.machine.step(v, r.lat, r.lon, r.ts_ms, r.speed_kn, r.heading_deg, r.flag_code)
        self._save(v, timerValues.getCurrentWatermarkInMs())
        return self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        v, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        out = self.machine.expire(v, now)
        self._save(v, now)
        return self._rows(key, out)

    def close(self) -> None:
        pass


def alerts(
    fixes: DataFrame,
    zones: DataFrame,
    patrols: DataFrame | None = None,
    settings: S.Settings = S.Settings(),
    delay: str = "0 seconds",
    forget_s: int | None = None,
) -> DataFrame:
    """ALERTS of streaming fixes (columns of FIX). Zones and patrols are read once, at the start; every worker holds
    all of them, so more than MOST_ZONES zones are an error, not a cut."""
    known = spatial.zone_rows(zones, MOST_ZONES)
    if not known:
        raise ValueError(f"no zones, or over {MOST_ZONES}")
    boats = [(p.patrol_id, p.lat, p.lon, p.max_speed_kn) for p in sorted(patrol_rows(patrols), key=lambda p: p.patrol_idx)]
    timed = fixes.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)
    return timed.groupBy("mmsi").transformWithState(Watch(areas(known), boats, settings, forget_s), ALERTS, "append", "EventTime")


def needs_rocksdb(spark) -> None:
    """Set the state store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

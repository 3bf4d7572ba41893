"""Ordered state per vessel: the previous fix, the ring of recent fixes, the gap to the next one, greedy spacing.

The window functions are partitioned by mmsi and ordered by (ts_ms, seq), so
Catalyst plans one exchange and one sort for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia import schema as S
from pelagia.functions import geo, rules

ORDER = ("ts_ms", "seq")


def by_vessel() -> Window:
    return Window.partitionBy("mmsi").orderBy(*ORDER)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by the hash of ``keys`` in as many partitions as the session says. What follows is heavy for each row, and
    AQE, which goes by bytes, would put a small table into a task or two."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_previous(fixes: DataFrame) -> DataFrame:
    """fixes with "prev" (lat, lon, ts_ms, zones if there are zones), null on a vessel's first fix, and "next_ts_ms"."""
    carried = [c for c in ("lat", "lon", "ts_ms", "zones") if c in fixes.columns]
    w = by_vessel()
    return dealt(fixes, "mmsi").withColumns({"prev": F.lag(F.struct(*carried)).over(w), "next_ts_ms": F.lead("ts_ms").over(w)})


def with_history(fixes: DataFrame, settings: S.Settings = S.Settings()) -> DataFrame:
    """fixes with "history": up to 16 fixes before this one, oldest first; fixes at time 0 don't count."""
    ring = F.collect_list(F.struct("ts_ms", "speed_kn", "heading_deg")).over(by_vessel().rowsBetween(-settings.history, -1))
    return fixes.withColumn("history", F.filter(ring, lambda f: f["ts_ms"] != 0))


def entered(zones: Column | str = "zones", prev: Column | str = "prev") -> Column:
    """Zones that the fix is in and the vessel's fix before was not."""
    before = F.transform(geo._c(prev)["zones"], lambda z: z["zone_idx"])
    return F.filter(geo._c(zones), lambda z: ~F.array_contains(before, z["zone_idx"]))


def track_measures(history: Column | str = "history") -> Column:
    """What a ring of fixes adds up to, in one pass: n, min, max, avg, first and last speed, mean sine and cosine of the
    headings, net rotation, fast/slow crossings (fast from 6 kn, slow from 3 kn; fast at the start from 4.5 kn)."""
    h = geo._c(history)
    zero = F.lit(0.0)
    first = h[0]["speed_kn"]
    start = F.struct(
        F.lit(0).alias("n"), first.alias("min"), first.alias("max"), zero.alias("sum"), zero.alias("sin"), zero.alias("cos"),
        zero.alias("rot"), h[0]["heading_deg"].alias("head"), F.when(first >= 4.5, 1).otherwise(0).alias("state"),
    )

    def step(a: Column, f: Column) -> Column:
        s, rad = f["speed_kn"], F.radians(f["heading_deg"])
        # the state is twice the crossings so far, plus 1 while fast
        fast = a["state"] % 2 == 1
        state = F.when(fast & (s <= 3.0), a["state"] + 1).when(~fast & (s >= 6.0), a["state"] + 3).otherwise(a["state"])
        return F.struct(
            (a["n"] + 1).alias("n"), F.least(a["min"], s).alias("min"), F.greatest(a["max"], s).alias("max"), (a["sum"] + s).alias("sum"),
            (a["sin"] + F.sin(rad)).alias("sin"), (a["cos"] + F.cos(rad)).alias("cos"),
            (a["rot"] + rules.heading_delta(a["head"], f["heading_deg"])).alias("rot"), f["heading_deg"].alias("head"), state.alias("state"),
        )

    def finish(a: Column) -> Column:
        return F.struct(
            a["n"].alias("n"), a["min"].alias("min_kn"), a["max"].alias("max_kn"), (a["sum"] / a["n"]).alias("avg_kn"),
            first.alias("first_kn"), h[F.size(h) - 1]["speed_kn"].alias("last_kn"),
            (a["sin"] / a["n"]).alias("mean_sin"), (a["cos"] / a["n"]).alias("mean_cos"),
            a["rot"].alias("net_rotation"), F.floor(a["state"] / 2).cast("int").alias("crossings"),
        )

    return F.when(F.size(h) > 0, F.aggregate(h, start, step, finish))


def fishing_pattern(measures: Column | str) -> tuple[Column, Column]:
    """(kind, text) of the gear that a track looks like, or nulls; seining before longlining before trawling."""
    m = geo._c(measures)
    n, rot = m["n"], F.abs(m["net_rotation"])
    spread = rules.course_std(m["mean_sin"], m["mean_cos"])
    seine = (n >= 10) & (rot >= 270.0) & (m["max_kn"] > 7.0) & (m["first_kn"] > 5.0) & (m["last_kn"] <= 2.5)
    line = (n >= 12) & (m["crossings"] >= 3) & (m["max_kn"] >= 7.0) & (m["min_kn"] <= 2.5) & (spread < 20.0)
    trawl = (n >= 12) & (m["min_kn"] >= 1.0) & (m["max_kn"] <= 5.5) & m["avg_kn"].between(2.0, 4.5) & (spread > 25.0)
    kind = F.when(seine, S.SEINING).when(line, S.LONGLINING).when(trawl, S.TRAWLING)
    text = (
        F.when(seine, F.concat(rules.whole(rot), F.lit(" deg net loop then stop")))
        .when(line, F.concat(F.lit("sawtooth speed, "), m["crossings"].cast("string"), F.lit(" fast/slow cycles on a straight track")))
        .when(trawl, F.concat(F.lit("slow 2.0-4.5 kn with course spread "), rules.whole(spread), F.lit(" deg (trawl-like)")))
    )
    return F.when(n >= 8, kind), F.when(n >= 8, text)


def spaced(rows: DataFrame, keys: list[str], order: list[str], at: str, wait_ms: Column, strict: bool, start_ms: int | None = None) -> DataFrame:
    """Greedy spacing: per key, in order, a row stays if it comes ``wait_ms`` or more (strict: more) after the last one
    that stayed. ``start_ms``: a time that counts as that of a row before the first.

    One pass over sorted rows: what is held is the time of the last row that stayed, so a key may have any number of
    rows. No built-in function folds a sorted stream, hence the Arrow map.
    """
    out = rows.schema
    timed = rows.withColumns({"_at": F.col(at).cast("long"), "_wait": wait_ms.cast("long")})
    ordered = dealt(timed, *keys).sortWithinPartitions(*keys, *order)
    places = [ordered.columns.index(c) for c in (*keys, "_at", "_wait")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            keep = []
            for *this, now, wait in zip(*(batch.column(p).to_pylist() for p in places), strict=True):
                if this != key:
                    key, last = this, start_ms
                ok = last is None or (now - last > wait if strict else now - last >= wait)
                if ok:
                    last = now
                keep.append(ok)
            yield batch.filter(pa.array(keep, pa.bool_())).select(out.names)

    return ordered.mapInArrow(run, out)

import json

import pytest

from pelagia import schema as S
from pelagia.plans.engine import Engine
from pelagia.sources import fixes as sources
from pelagia.streaming import machine, replay, sinks, vessels
from tests.test_engine import HOUR, MPA, T0, box, fixes_of, voyage, zones_of

SETTINGS = S.Settings(playback_speed=60.0, as_of_ms=T0 + 10 * HOUR)


def key(kind, mmsi, at, score, severity):
    return kind, mmsi, at, score, severity


def batch_alerts(spark):
    z = zones_of(spark, MPA, ("sea", "eez", "IN", box(77, 81, 8, 13)))
    p = spark.createDataFrame([(0, "P1", "x", 9.28, 79.30, 25.0)], S.PATROL)
    e = Engine(fixes_of(spark, voyage()), z, p, settings=SETTINGS)
    rows = e.alerts().collect()
    e.close()
    return z, p, rows


def test_machine_equals_batch(spark):
    z, p, rows = batch_alerts(spark)
    m = machine.Machine(machine.areas(sorted(z.collect(), key=lambda r: r.zone_idx)), [("P1", 9.28, 79.30, 25.0)], SETTINGS)
    got = []
    for mmsi in range(1, 6):
        v = machine.Vessel()
        for _, lat, lon, speed, heading, ts, flag in sorted((r for r in voyage() if r[0] == mmsi), key=lambda r: r[5]):
            v = vessels.from_json(vessels.to_json(v))
            got += [a | {"mmsi": mmsi} for a in m.step(v, lat, lon, ts, speed, heading, flag)]
        got += [a | {"mmsi": mmsi} for a in m.expire(v, SETTINGS.as_of_ms)]
    assert sorted(key(a["kind"], a["mmsi"], a["at_ms"], a["score"], a["severity"]) for a in got) == sorted(key(r.kind, r.mmsi, r.at_ms, r.score, r.severity) for r in rows)
    darks = {(a["mmsi"], a["at_ms"]): a for a in got if a["kind"] == S.DARK}
    for r in rows:
        if r.kind == S.DARK:
            a = darks[r.mmsi, r.at_ms]
            assert (a["zone_id"], a["silence_s"], a["cone"][4]) == (r.zone_id, r.detail.silence_s, r.cone.radius_m)
            assert a["intercepts"] == [tuple(i) for i in r.intercepts]


def test_stream_equals_batch(spark, tmp_path):
    z, p, rows = batch_alerts(spark)
    vessels.needs_rocksdb(spark)
    # in order of time over three files, then far-off fixes that move the watermark on
    by_time = sorted(voyage(), key=lambda r: r[5])
    first, second = by_time[len(by_time) // 3][5], by_time[2 * len(by_time) // 3][5]
    # rows of one time come together: those at the watermark count as late
    parts = [[r for r in by_time if lo < r[5] <= hi] for lo, hi in ((0, first), (first, second), (second, T0 + HOUR))]
    parts += [[(9, 0.0, 0.0, 0.0, 0.0, T0 + h * HOUR, 0)] for h in (20, 21)]
    for k, part in enumerate(parts):
        fixes_of(spark, part).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    out = []
    for k in range(len(parts)):
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
        fixes = spark.readStream.schema(S.FIX).parquet(str(tmp_path / "in"))
        q = sinks.start(vessels.alerts(fixes, z, p, SETTINGS), lambda b, n: out.extend(b.collect()), str(tmp_path / "cp"))
        q.awaitTermination(180)
    got = {key(r.kind, r.mmsi, r.at_ms, r.score, r.severity) for r in out}
    want = {key(r.kind, r.mmsi, r.at_ms, r.score, r.severity) for r in rows}
    assert (got - want, want - got, len(out)) == (set(), set(), len(rows))


def test_replay_and_frames(spark, tmp_path):
    lines = [json.dumps({"MessageType": "PositionReport", "MetaData": {"MMSI": 219000001, "ShipName": "A"}, "Message": {"PositionReport": {"UserID": 219000001, "Sog": 5.0, "Cog": 1.0, "TrueHeading": 2, "Latitude": 55.0, "Longitude": 11.0 + k / 100}}}) for k in range(7)]
    (tmp_path / "rec.jsonl").write_text("\n".join([*lines, "{broken"]) + "\n")
    spark.dataSource.register(replay.RecordedFrames)
    raw = spark.readStream.format("recorded_frames").option("path", str(tmp_path / "rec.jsonl")).option("rows", "3").option("start_ms", str(T0)).load()
    from pyspark.sql import functions as F

    fixes = sources.normalize_live(sources.decode_live(raw, received_ms=F.col("received_ms")))
    q = fixes.writeStream.foreachBatch(sinks.frames(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    q.stop()
    told = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(t["alert"]["ts_ms"] - T0 for t in told) == [k * 1000 for k in range(7)] and told[0]["type"] == "alert"


def test_rates_and_counters(spark, tmp_path):
    fixes_of(spark, [(1, 0.0, 0.0, 0.0, 0.0, T0 + t, 0) for t in (0, 100, 999, 1000, 60_000)]).write.parquet(str(tmp_path / "in"))
    stream = sinks.counted(spark.readStream.schema(S.FIX).parquet(str(tmp_path / "in")))
    q = sinks.per_second(stream).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("rates").collect()) == [1, 3]
    assert q.recentProgress[0].observedMetrics["fixes"].ingested == 5


def test_waits():
    assert replay.waits([0, 0, 0, 0, 0, 3, 0]) == [5, 10, 20, 40, 60, 5, 10]


def test_late_rows_are_counted_not_mixed_in(spark):
    # an older fix that comes later takes its place in time, in batch as in one micro-batch
    z = zones_of(spark, MPA)
    rows = [(1, 9.0, 79.1, 5.0, 0.0, T0 + 60_000, 1), (1, 8.5, 79.1, 5.0, 0.0, T0, 1)]
    got = Engine(fixes_of(spark, rows), z, settings=S.Settings(as_of_ms=T0 + 61_000)).alerts().collect()
    assert S.ZONE_VIOLATION in [r.kind for r in got]


@pytest.mark.parametrize("lat, lon, nm", [(9.0, 79.1, 0.0), (9.0, 78.9, 5.9)])
def test_area_distance(lat, lon, nm):
    a = machine.Area(0, "park", S.MPA, 0, [[tuple(p) for p in r] for r in MPA[3]])
    assert abs(a.nm(lat, lon) - nm) < 0.1

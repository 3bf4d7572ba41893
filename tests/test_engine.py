import json
import random

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pelagia import queries
from pelagia import schema as S
from pelagia.functions import geo
from pelagia.operators import detectors, feed, metrics, risk, spatial, tracks
from pelagia.plans import demo
from pelagia.plans.engine import Engine, patrol_rows, with_weather
from pelagia.sources import dimensions
from tests.conftest import as_rows, duck

FIXED = ["mmsi", "lat", "lon", "speed_kn", "heading_deg", "ts_ms", "flag_code", "seq"]
T0 = 1_720_000_000_000


def zones_of(spark, *zones):
    """(id, type, country, ring) each."""
    features = [{"properties": {"id": i, "type": t, "country": c}, "geometry": {"type": "Polygon", "coordinates": rings}} for i, t, c, rings in zones]
    return dimensions.zones_of_text(spark, json.dumps({"features": features}))


def box(x1, x2, y1, y2):
    return [[[x1, y1], [x2, y1], [x2, y2], [x1, y2], [x1, y1]]]


def fixes_of(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], S.FIX)


MPA = ("park", "mpa", None, box(79.0, 79.3, 8.9, 9.3))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_query_against_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = duck(sf).execute(queries.ORACLES[name]).df()
    assert as_rows(got) == as_rows(want)
    spark.catalog.clearCache()


@pytest.mark.parametrize("lat, lon, want", [(0.5, 0.5, 1), (0.35, 0.65, 1), (0.02, 0.5, 1), (0.5, 1.5, 0), (-0.5, 0.5, 0), (-0.02, 0.5, 0), (0.0, 0.5, 1), (1.0, 1.0, 1)])
def test_containment(spark, lat, lon, want):
    z = zones_of(spark, ("a", "mpa", None, box(0, 1, 0, 1)))
    f = fixes_of(spark, [(1, lat, lon, 0.0, 0.0, T0, 0)])
    for rows in (spatial.inside(f, z), spatial.inside_by_cells(f, z, 0.1)):
        assert len(rows.first().zones) == want


def test_cells_and_expressions_agree_on_slivers(spark):
    random.seed(2)
    shapes = []
    for k in range(12):
        x, y = random.uniform(0, 1), random.uniform(0, 1)
        ring = [[x, y], [x + random.uniform(0.01, 0.6), y + random.uniform(-0.02, 0.02)], [x + random.uniform(0, 0.5), y + random.uniform(0.001, 0.05)]]
        shapes.append((f"s{k}", "mpa", None, [[*ring, ring[0]]]))
    shapes.append(("hole", "mpa", None, [*box(0.2, 0.8, 0.2, 0.8), *box(0.4, 0.6, 0.4, 0.6)]))
    z = zones_of(spark, *shapes)
    f = fixes_of(spark, [(k, random.uniform(0, 1.2), random.uniform(0, 1.5), 0.0, 0.0, T0, 0) for k in range(3000)])
    pick = lambda rows: sorted((r.mmsi, tuple(x.zone_id for x in r.zones)) for r in rows.collect())
    a, b = pick(spatial.inside(f, z)), pick(spatial.inside_by_cells(f, z, 0.05))
    assert a == b and sum(len(x[1]) for x in a) > 300
    few = S.Settings(inline_zones=3)
    assert pick(spatial.inside(f, z, few)) == a  # more zones than fit an expression go by cells


def test_thin_zone_off_the_grid(spark):
    z = zones_of(spark, ("thin", "fishing-banned", None, box(79.15, 79.26, 9.26, 9.29)))
    f = fixes_of(spark, [(1, 9.275, 79.225, 0.0, 0.0, T0, 0)])
    assert spatial.inside_by_cells(f, z, 0.05).first().zones[0].zone_id == "thin"


def dark(spark, rows, **settings):
    s = S.Settings(as_of_ms=T0 + settings.pop("silence_ms"), **settings)
    z = zones_of(spark, MPA)
    e = Engine(fixes_of(spark, rows), z, spark.createDataFrame([(0, "P1", "x", 9.28, 79.30, 25.0)], S.PATROL), settings=s)
    return e.alerts().where("kind = 'DARK_EVENT'").collect()


def test_darkness(spark):
    here = (1, 9.05, 79.15, 8.0, 210.0, T0, 2)
    got = dark(spark, [here], silence_ms=100_000)
    assert len(got) == 1 and got[0].severity == "HIGH" and got[0].zone_id == "park" and got[0].at_ms == T0 + 60_000
    assert (got[0].cone.heading_deg, got[0].cone.spread_deg, got[0].cone.radius_m) == (210.0, 30.0, 124.7)  # at 60 s, when it is told
    assert got[0].intercepts[0].patrol_id == "P1" and got[0].intercepts[0].eta_s > 0
    assert len(dark(spark, [here], silence_ms=3_000_000)) == 1
    assert dark(spark, [(*here[:3], 0.5, *here[4:])], silence_ms=100_000) == []
    assert dark(spark, [(1, 5.0, 85.0, *here[3:])], silence_ms=100_000) == []
    assert dark(spark, [here], silence_ms=30_000) == []
    assert dark(spark, [here], silence_ms=100_000, min_silence_s=900.0) == []
    only = zones_of(spark, ("eez", "eez", "IN", box(79.0, 79.3, 8.9, 9.3)))
    rows = Engine(fixes_of(spark, [here]), only, settings=S.Settings()).alerts().collect()
    assert [r.kind for r in rows] == ["DARK_EVENT"]  # with economic zones alone, those count


def test_every_patrol_of_a_large_fleet(spark):
    boats = spark.createDataFrame([(k, f"P{k}", "x", 9.0 + k / 1000, 79.3, 25.0) for k in range(1_001)], S.PATROL)
    e = Engine(fixes_of(spark, [(1, 9.05, 79.15, 8.0, 210.0, T0, 2)]), zones_of(spark, MPA), boats, settings=S.Settings(as_of_ms=T0 + 100_000))
    got = e.alerts().where("kind = 'DARK_EVENT'").first()
    assert [i.patrol_id for i in got.intercepts] == [f"P{k}" for k in range(1_001)]
    with pytest.raises(ValueError):
        patrol_rows(boats, 1_000)
    e.close()


def test_more_zones_than_fit_an_expression(spark):
    """10,001 small zones by cells: entries and darkness as by expressions over the few that matter."""
    near = [(f"z{k}", "mpa" if k % 3 else "eez", "IN", box(79.0 + 0.02 * k, 79.011 + 0.02 * k, 8.9, 8.93)) for k in range(20)]
    more = [(f"far{k}", "mpa", None, box(10 + 0.1 * (k % 100), 10.05 + 0.1 * (k % 100), 30 + 0.1 * (k // 100), 30.05 + 0.1 * (k // 100))) for k in range(9_981)]  # 10,001 in all
    random.seed(5)
    rows = [(k % 9, random.uniform(8.6, 9.2), random.uniform(78.7, 79.6), random.choice([0.5, 8.0, 18.0]), random.uniform(0, 359), T0 + 40_000 * (k // 9), 2) for k in range(700)]
    told = []
    for shapes in (near, near + more):
        e = Engine(fixes_of(spark, rows), zones_of(spark, *shapes), settings=S.Settings(as_of_ms=T0 + HOUR))
        told.append(sorted((r.kind, r.mmsi, r.at_ms, r.zone_id, r.score) for r in e.alerts().where(F.col("kind").isin(S.DARK, S.ZONE_VIOLATION)).collect()))
        e.close()
    assert told[0] == told[1] and {k for k, *_ in told[0]} == {S.DARK, S.ZONE_VIOLATION} and len(told[0]) > 40


def test_readings_of_the_weather_by_stretches(spark):
    random.seed(3)
    reads = [(random.randint(0, 60) / 10, T0 + random.randint(-2 * HOUR, 5 * HOUR), random.random() < 0.9) for _ in range(40)]
    rows = [(S.TRAWLING if k % 2 else S.DARK, k, T0 + random.randint(-HOUR, 6 * HOUR)) for k in range(200)]
    df = spark.createDataFrame(rows, "kind STRING, seq LONG, at_ms LONG").withColumns({"detail": detectors._detail(), "severity": F.lit("HIGH")})
    got = {r.seq: r.detail.sea_state_m for r in with_weather(df, spark.createDataFrame(reads, S.WEATHER)).collect()}
    for kind, k, at in rows:
        known = [(t, w) for w, t, ok in reads if ok and t <= at and at - t <= 1_800_000]
        assert got[k] == (max(known)[1] if kind == S.TRAWLING and known else None)
    assert len(got) == len(rows)


def events(spark, *rows):
    return spark.createDataFrame([(1, k, at, 0, i) for i, (k, at) in enumerate(rows)], "mmsi LONG, kind STRING, at_ms LONG, rank INT, seq LONG")


NOW, HOUR = 1_700_000_000_000, 3_600_000


@pytest.mark.parametrize(
    "found, score, tier",
    [
        ([(S.ZONE_VIOLATION, NOW)], 90, "CRITICAL"), ([(S.ZONE_VIOLATION, NOW), (S.TRAWLING, NOW)], 100, "CRITICAL"), ([(S.DARK, NOW)], 15, "LOW"),
        ([(S.DARK, NOW), (S.SPOOF, NOW)], 30, "LOW"), ([(S.DARK, NOW), (S.SPOOF, NOW), (S.SEINING, NOW)], 50, "ELEVATED"),
        ([(S.DARK, NOW)] * 4 + [(S.SPOOF, NOW)], 60, "ELEVATED"), ([(S.DARK, NOW)] * 6 + [(S.SPOOF, NOW), (S.LONGLINING, NOW)], 100, "CRITICAL"),
        ([(S.ZONE_VIOLATION, NOW - 24 * HOUR)], 45, "ELEVATED"), ([(S.ZONE_VIOLATION, NOW - 48 * HOUR - 1)], 0, "LOW"),
        ([(S.DARK, NOW - k) for k in range(20, 0, -1)], 100, "CRITICAL"),
    ],
)
def test_scores(spark, found, score, tier):
    got = risk.snapshot(events(spark, *found), NOW).first()
    assert (got.score, got.tier) == (score, tier)
    assert [f.code for f in got.factors] == [c for c in ("ZONE", "DARK", "SPOOF", "FISHING") if c in {f.code for f in got.factors}]
    assert score or not got.factors


def test_only_sixteen_dark_events_count(spark):
    rows = [(S.DARK, NOW - 40 * HOUR + k) for k in range(30)]
    state = risk.with_state(events(spark, *rows)).where("seq = 29").first().state
    assert len(state.dark_ms) == 16 and state.dark_ms[-1] == NOW - 40 * HOUR + 29


def test_tier_alert_comes_again_after_decay(spark):
    rows = [(S.ZONE_VIOLATION, NOW), (S.SPOOF, NOW + 1000), (S.ZONE_VIOLATION, NOW + 30 * HOUR)]
    got = [r.sweep_ms for r in risk.suspected(events(spark, *rows)).orderBy("sweep_ms").collect()]
    assert len(got) == 2 and all(t % 5000 == 0 for t in got)


def track(mmsi, n, lat, lon, speed, heading, start=0, step=60_000, flag=4):
    return [(mmsi, lat(k), lon(k), float(speed(k)), float(heading(k)), T0 + start + k * step, flag) for k in range(n)]


def voyage():
    """A trawler in the park, a jumper, a liner, a seiner, and honest traffic."""
    weave = [3, 2.5, 4, 3.5, 2.2, 4.2, 3, 2.8, 3.5, 4, 2.5, 3, 3.8, 2.6, 3.3, 4.1]
    rows = track(1, 40, lambda k: 8.88 + 0.002 * min(k, 20), lambda k: 79.1, lambda k: weave[k % 16], lambda k: 75 * k % 360)
    rows += track(2, 6, lambda k: 9.0 + 3 * (k == 3), lambda k: 79.2, lambda k: 25, lambda k: 5)
    rows += track(3, 30, lambda k: 8.85 + 0.01 * min(k, 20), lambda k: 79.25, lambda k: 8 if k % 2 else 2, lambda k: 90)
    ramp = [9, 9, 8, 8, 9, 8, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1]
    rows += track(4, 17, lambda k: 8.89 + 0.02 * (k > 0), lambda k: 79.05, lambda k: ramp[k], lambda k: 30 * k % 360)
    rows += track(5, 30, lambda k: 8.5, lambda k: 78.0 + 0.001 * k, lambda k: 12, lambda k: 90, step=10_000)
    random.seed(1)
    random.shuffle(rows)
    return rows


def test_story(spark):
    s = S.Settings(playback_speed=60.0, as_of_ms=T0 + 10 * HOUR)
    names = spark.createDataFrame([(1, "TRAWLER")], S.NAME)
    e = Engine(fixes_of(spark, voyage()), zones_of(spark, MPA, ("sea", "eez", "IN", box(77, 81, 8, 13))), names=names, settings=s)
    got = e.alerts().orderBy("id").collect()
    e.close()
    kinds = lambda m: [r.kind for r in got if r.mmsi == m]
    assert kinds(1).count(S.ZONE_VIOLATION) == 1 and kinds(1).count(S.TRAWLING) == 1 and S.SUSPECTED in kinds(1)
    assert kinds(2).count(S.SPOOF) == 2 and S.LONGLINING in kinds(3) and S.SEINING in kinds(4)
    assert set(kinds(5)) <= {S.DARK} and not [k for k in kinds(5)]  # far from the park
    assert [r.name for r in got if r.mmsi == 1][0] == "TRAWLER" and [r.name for r in got if r.mmsi == 2][0] == ""
    assert [r.id for r in got] == [f"a-{k:06d}" for k in range(1, len(got) + 1)]
    rough = spark.createDataFrame([(2.4, T0, True), (9.0, T0 + 60_000, False)], S.WEATHER)
    wet = Engine(e.fixes, e.zones, weather=rough, settings=s).alerts().where(F.col("kind") == S.TRAWLING).first()
    assert (wet.severity, wet.detail.weather_confidence, wet.detail.sea_state_m) == ("MEDIUM", "LOW", 2.4)


def test_debounce_is_greedy(spark):
    times = [0, 10, 25, 30, 31, 59, 62, 100, 131]
    rows = spark.createDataFrame([(1, t * 60_000 + 1_800_001, k) for k, t in enumerate(times)], "mmsi LONG, ts_ms LONG, seq LONG")
    got = tracks.spaced(rows, ["mmsi"], ["ts_ms", "seq"], "ts_ms", F.lit(1_800_000), strict=True, start_ms=0).orderBy("ts_ms").collect()
    assert [(r.ts_ms - 1_800_001) // 60_000 for r in got] == [0, 31, 62, 100, 131]


def plain_feed(rows, cap, tick):
    shown, sent, now, out = {}, 0, None, []
    for r in sorted(rows, key=lambda r: (r["at_ms"], r["rank"], r["mmsi"], r["seq"], r["zone_id"])):
        if r["at_ms"] // tick != now:
            now, sent = r["at_ms"] // tick, 0
        code = {S.ZONE_VIOLATION: 0, S.SPOOF: 1, S.DARK: 2, S.SUSPECTED: 3}.get(r["kind"], 5)
        last = shown.get((r["mmsi"], code))
        if (last is None or r["at_ms"] - last >= (90_000 if code == 1 else 20_000)) and sent < cap:
            shown[r["mmsi"], code] = r["at_ms"]
            sent += 1
            out.append(r["seq"])
    return sorted(out)


def test_feed_against_a_loop(spark):
    random.seed(8)
    kinds = [S.ZONE_VIOLATION, S.SPOOF, S.DARK, S.SUSPECTED, S.TRAWLING, S.SEINING]
    rows = [{"kind": random.choice(kinds), "mmsi": random.randint(1, 4), "at_ms": T0 + random.choice([0, 500_000, 10**6]) + random.randint(0, 150) * 400, "rank": random.randint(0, 2), "seq": k, "zone_id": ""} for k in range(1500)]
    df = spark.createDataFrame(rows, "kind STRING, mmsi LONG, at_ms LONG, rank INT, seq LONG, zone_id STRING")
    got = sorted(r.seq for r in feed.feed(df, S.Settings(feed_cap=3)).collect())
    assert got == plain_feed(rows, 3, 1000)
    wide = df.withColumn("at_ms", F.col("at_ms") * 1 + F.col("seq") * 7_000)  # the cap acts in some segments only
    few = [r.asDict() for r in wide.collect()]
    assert sorted(r.seq for r in feed.feed(wide, S.Settings(feed_cap=1)).collect()) == plain_feed(few, 1, 1000)
    assert feed.feed(df.limit(0)).collect() == []


def test_percentiles(spark):
    h = spark.createDataFrame([(0, 1), (3, 98), (10, 1)], "bucket INT, n LONG")
    assert tuple(metrics.percentiles(h, 50, 99, 100, 0).first()) == (12.0, 12.0, 1536.0, 1.5)
    assert tuple(metrics.percentiles(h.limit(0), 50, 99).first()) == (0.0, 0.0)


def test_frames(spark):
    s = S.Settings(playback_speed=60.0, as_of_ms=T0 + 10 * HOUR)
    e = Engine(fixes_of(spark, voyage()), zones_of(spark, MPA), spark.createDataFrame([(0, "P1", "x", 9.28, 79.30, 25.0)], S.PATROL), settings=s)
    found = e.alerts()
    told = [json.loads(r.frame)["alert"] for r in feed.envelope(found).collect()]
    darks = [a for a in told if a["kind"] == S.DARK]
    assert darks and all("cone" in a and "intercepts" in a for a in darks)
    assert all("cone" not in a and "intercepts" not in a for a in told if a["kind"] == S.SPOOF)
    assert all("factors" in a and a["detail"]["tier"] for a in told if a["kind"] == S.SUSPECTED)
    snap = risk.snapshot(e.detected(), s.as_of_ms)
    frame = json.loads(metrics.positions_frame(metrics.positions(metrics.latest(e.fixes), snap)).first().frame)
    props = {f["properties"]["mmsi"]: f["properties"] for f in frame["fc"]["features"]}
    assert len(props) == 5 and "risk_tier" not in props[5] and props[1]["risk_score"] > 0 and frame["type"] == "positions"
    assert feed.vessel_alerts(found, 1).count() == found.where("mmsi = 1").count()
    w = spark.createDataFrame([(1.5, T0, True)], S.WEATHER)
    assert metrics.weather_frame(w, T0 + 1).first().available and not metrics.weather_frame(w, T0 + HOUR).first().available
    e.close()


@pytest.mark.parametrize("critical, lost, want", [(0, 0, ("Low", "99.9%")), (1, 5, ("Medium", "99.5%")), (3, 100, ("High", "91%"))])
def test_cards(spark, critical, lost, want):
    a = spark.createDataFrame([(S.ZONE_VIOLATION, "CRITICAL")] * critical + [(S.DARK, "HIGH")], "kind STRING, severity STRING")
    got = metrics.cards(a, 1000, lost).first()
    assert (got.threat_level, got.integrity) == want and got.n_alerts == critical


def test_one_exchange_of_the_fixes(spark, sf):
    """The whole batch plan up to the alerts shuffles the fixes once and runs no Python."""
    e = queries.engine(spark, sf)
    plan = detectors.all_at_once(e.tracked(), spatial.zone_rows(e.zones, 100), [], e.settings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_fleet_by_rows_is_the_arrays(spark, sf):
    """Rows per silence and patrol have the arrays' numbers; the fleet's work is compiled, no lambda runs per patrol."""
    random.seed(4)
    silent = [(k, k, k, 55 + random.random(), 11 + random.random(), random.choice([0.0, 8.0, random.random() * 30]), random.choice([0.0, 90.0, random.random() * 360, None]), 7200.0) for k in range(60)]
    silent = spark.createDataFrame(silent, "mmsi LONG, ts_ms LONG, seq LONG, lat DOUBLE, lon DOUBLE, speed_kn DOUBLE, heading_deg DOUBLE, silence_s DOUBLE")
    boats = [Row(patrol_idx=k, patrol_id=f"B{k}", lat=55 + random.random(), lon=11 + random.random(), max_speed_kn=random.choice([0.0, 8.0, random.random() * 40])) for k in range(50)]
    lat, lon = detectors.predicted(F.col("speed_kn"), F.col("silence_s"), F.col("lat"), F.col("lon"), F.col("heading_deg"))
    arrays = silent.select("mmsi", "ts_ms", "seq", F.explode(detectors.patrol_intercepts(boats, lat, lon, F.col("speed_kn"), F.col("heading_deg"))).alias("i")).select("mmsi", "ts_ms", "seq", "i.*")
    got, want = detectors.intercept_rows(silent, boats).collect(), arrays.collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and 0 < sum(r.feasible for r in got) < len(got) == 3000
    assert detectors.intercept_rows(silent, []).count() == 0
    plan = queries.dark_intercepts_fleet(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "lambda" not in plan.split("Generate explode")[0]


def test_empty_fixes(spark):
    e = Engine(spark.createDataFrame([], S.FIX), demo.zones(spark), demo.patrols(spark))
    assert e.alerts().collect() == [] and metrics.latest(e.fixes).collect() == []
    assert isinstance(as_rows(pd.DataFrame({"a": []})), list) and geo.M_PER_DEG == 111_320.0

import math

import pytest
from pyspark.sql import functions as F

from pelagia import schema as S
from pelagia.functions import geo, rules
from pelagia.operators import tracks


def one(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


@pytest.mark.parametrize("a, b, want, tol", [((9.0, 79.0), (9.1, 79.0), 11132, 5), ((0, 79), (0, 79.1), 11132, 5), ((60, 79), (60, 79.1), 5566, 20), ((9, 79), (9, 79), 0, 0)])
def test_distance(spark, a, b, want, tol):
    assert abs(one(spark, geo.distance_m(*a, *b)) - want) <= tol


def test_units(spark):
    got = one(spark, geo.knots_to_mps(60.0), geo.mps_to_knots(30.8667), geo.meters_to_nm(1852.0), geo.nm_to_meters(2.0))
    assert [round(x, 3) for x in got] == [30.867, 60.0, 1.0, 3704.0]


@pytest.mark.parametrize("heading, lat, lon", [(0, 9.1, 79.0), (180, 8.9, 79.0), (90, 9.0, 79.1012), (270, 9.0, 78.8988)])
def test_dead_reckoning(spark, heading, lat, lon):
    y, x = geo.dead_reckon(9.0, 79.0, heading, 11132.0)
    got = one(spark, y, x)
    assert abs(got[0] - lat) < 1e-3 and abs(got[1] - lon) < 1e-3


def test_intercepts(spark):
    a, b, c, still = one(
        spark, geo.intercept(9.1, 79.0, 20.0, 9.0, 79.0, 0.001, 0.0), geo.intercept(9.0, 79.0, 5.0, 9.05, 79.0, 40.0, 0.0),
        geo.intercept(8.9, 79.0, 30.0, 9.0, 79.0, 10.0, 90.0), geo.intercept(8.9, 79.0, 0.0, 9.0, 79.0, 10.0, 90.0),
    )
    assert a.feasible and abs(a.heading_deg - 180) <= 1 and abs(a.eta_s - 1082) <= 30
    assert not b.feasible and b.eta_s > 0
    assert c.feasible and 0 < c.heading_deg < 90
    assert not still.feasible and still.eta_s is None  # a patrol that can't move


def test_least_root(spark):
    root = geo.smallest_positive_root
    got = one(spark, root(1.0, -3.0, 2.0), root(0.0, 2.0, -4.0), root(1.0, 0.0, 1.0), root(0.0, 0.0, 1.0), root(1.0, 3.0, 2.0), root(-1.0, 0.0, 4.0))
    assert got == (1.0, 2.0, None, None, None, 2.0)


@pytest.mark.parametrize(
    "kind, country, flag, want",
    [("mpa", 0, 1, True), ("mpa", 0, 0, True), ("eez", 1, 1, False), ("eez", 1, 2, True), ("eez", 1, 0, False), ("port", 1, 2, False)],
)
def test_zone_rule(spark, kind, country, flag, want):
    assert one(spark, rules.zone_violation(F.lit(kind), country, flag)) is want


@pytest.mark.parametrize(
    "lat, before, now, want",
    [(9.0, 0, 10_000, 0), (9.001, 0, 10_000, 0), (9.0027, 0, 10_000, 0), (9.0029, 0, 10_000, 60), (9.0006, 0, 1_000, 0), (9.0013, 0, 4_000, 60),
     (10.0, 0, 60_000, 60), (10.0, 5_000, 5_000, 9999), (10.0, 0, 7_200_000, 0), (9.5, 60_000, 0, 0)],
)
def test_jumps(spark, lat, before, now, want):
    d, dt = geo.distance_m(9.0, 79.0, lat, 79.0), F.lit(now - before)
    told, kn = one(spark, rules.spoofed(d, dt), rules.implied_kn(d, dt))
    assert told is (want > 0) and (not want or kn >= want)


RAMP = [9, 9, 8, 8, 9, 8, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1]


@pytest.mark.parametrize(
    "speeds, headings, want",
    [
        ([3, 2.5, 4, 3.5, 2.2, 4.2, 3, 2.8, 3.5, 4, 2.5, 3, 3.8, 2.6, 3.3, 4.1], [45 * i % 360 for i in range(16)], S.TRAWLING),
        ([8, 2] * 8, [90] * 16, S.LONGLINING),
        (RAMP, [30 * i % 360 for i in range(16)], S.SEINING),
        ([10, 10, 9, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1, 1, 1], [90] * 16, None),
        ([9, 9, 8, 8, 7, 7, 6, 5, 4, 3, 2, 1, 1, 1, 1, 1], [0, 60] * 8, None),
        ([3] * 16, [90] * 16, None),
        ([3] * 4, [0, 90, 180, 270], None),
    ],
)
def test_gear(spark, speeds, headings, want):
    from pelagia.streaming.machine import gear

    ring = [(1000 + i * 10_000, float(s), float(h)) for i, (s, h) in enumerate(zip(speeds, headings))]
    df = spark.createDataFrame([(ring,)], "history ARRAY<STRUCT<ts_ms: LONG, speed_kn: DOUBLE, heading_deg: DOUBLE>>").withColumn("m", tracks.track_measures())
    kind, text = tracks.fishing_pattern("m")
    got = df.select(kind.alias("k"), text.alias("t")).first()
    plain = gear(ring) or (None, None)
    assert got.k == want == plain[0]
    # headings that cancel out leave a mean of nothing but rounding, and the spread's text with it
    assert want == S.TRAWLING or got.t == plain[1]


@pytest.mark.parametrize(
    "kind, wave, want",
    [(S.TRAWLING, 0.5, "HIGH"), (S.TRAWLING, 1.3, ""), (S.TRAWLING, 2.0, "LOW"), (S.TRAWLING, 3.1, "LOW"), (S.LONGLINING, 0.5, "HIGH"), (S.LONGLINING, 2.0, ""),
     (S.LONGLINING, 2.5, "LOW"), (S.SEINING, 0.3, ""), (S.SEINING, 3.5, ""), (S.ZONE_VIOLATION, 3.0, "")],
)
def test_weather(spark, kind, wave, want):
    assert one(spark, rules.weather_confidence(F.lit(kind), F.lit(wave))) == want


def test_tiers(spark):
    t = lambda n: rules.tier(F.lit(n))
    assert one(spark, *[t(n) for n in (0, 39, 40, 64, 65, 84, 85, 100)]) == ("LOW", "LOW", "ELEVATED", "ELEVATED", "HIGH", "HIGH", "CRITICAL", "CRITICAL")
    c = lambda a, b, want="HIGH": rules.crossed_up_to(F.lit(a), F.lit(b), want)
    got = one(spark, c("ELEVATED", "HIGH"), c("HIGH", "HIGH"), c("ELEVATED", "CRITICAL"), c("CRITICAL", "HIGH"), c("", "ELEVATED"), c("HIGH", "CRITICAL", "CRITICAL"))
    assert got == (True, False, True, False, False, True)
    assert one(spark, rules.severity(84), rules.severity(85)) == ("HIGH", "CRITICAL")


def test_rounding_and_texts(spark):
    got = one(
        spark, rules.round1(F.lit(1.25)), rules.round1_away(F.lit(-1.25)), rules.whole(F.lit(382.5)), rules.points(90, 86_400_000, 86_400_000), rules.alert_id(7),
        rules.compact(F.lit(8_523_519)), rules.compact(F.lit(8523)), rules.compact(F.lit(85)), rules.compact(F.lit(None)), rules.ago_suffix(F.lit(0), F.lit(1)),
        rules.ago_suffix(F.lit(1), F.lit(180_001)), rules.runner_name(F.lit(420_000_007)), rules.bar_percent(F.lit(50.0), F.lit(100.0)), rules.bar_percent(F.lit(1.0), F.lit(0.0)),
    )
    assert got == (1.3, -1.3, "382", 45, "a-000007", "8.5M", "8.5k", "85", "—", "", " · updated 3m ago", "RUNNER-7", 50.0, 2.0)


def test_flags_kinds_and_codes(spark):
    got = one(spark, *[rules.flag_from_mmsi(F.lit(n * 1_000_000)) for n in (219, 220, 244, 246, 247, 419)])
    assert got == (4, 4, 3, 3, 255, 255)
    assert one(spark, *[rules.country_code(F.lit(c)) for c in ("IN", "LK", "NL", "DK", "XX")]) == (1, 2, 3, 4, 0)
    assert one(spark, *[rules.zone_kind(F.lit(k)) for k in ("coral-reef", "eez", "fishing-banned", "ecological-zone", "port")]) == ("mpa", "eez", "mpa", "mpa", "port")
    kinds = (S.ZONE_VIOLATION, S.SPOOF, S.DARK, S.SUSPECTED, S.BOARDING, S.TRAWLING, S.SEINING)
    assert one(spark, *[rules.feed_code(F.lit(k)) for k in kinds]) == (0, 1, 2, 3, 4, 5, 5)
    assert one(spark, rules.feed_cooldown_ms(F.lit(S.SPOOF)), rules.feed_cooldown_ms(F.lit(S.DARK))) == (90_000, 20_000)


def test_histogram_buckets(spark):
    got = one(spark, *[rules.hist_bucket(F.lit(x)) for x in (-1.0, 0.0, 0.99, 1.0, 1.99, 2.0, 1500.0, 2.0**40)])
    assert got == (0, 0, 0, 0, 0, 1, 10, 31)


def test_spread_of_courses(spark):
    assert one(spark, rules.course_std(F.lit(0.0), F.lit(0.0)), rules.course_std(F.lit(1.0), F.lit(0.0))) == (180.0, 0.0)
    assert math.isclose(one(spark, rules.course_std(F.lit(0.5), F.lit(0.0))), math.degrees(math.sqrt(-2 * math.log(0.5))))
    assert one(spark, rules.heading_delta(F.lit(350.0), F.lit(10.0)), rules.heading_delta(F.lit(0.0), F.lit(180.0)), rules.heading_delta(F.lit(180.0), F.lit(0.0))) == (20.0, 180.0, -180.0)

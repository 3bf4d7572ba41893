"""Scalar rules: flags, zone kinds, speeds, risk points, tiers, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pelagia import schema as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def country_code(name) -> Column:
    out = F.lit(0)
    for k, v in S.COUNTRY.items():
        out = F.when(_c(name) == k, v).otherwise(out)
    return out


def flag_from_mmsi(mmsi) -> Column:
    """By the identifier's leading three digits: Danish or Dutch, else some other country."""
    mid = F.floor(_c(mmsi) / F.lit(1_000_000)).cast("int")
    return F.when(mid.isin(219, 220), S.COUNTRY["DK"]).when(mid.between(244, 246), S.COUNTRY["NL"]).otherwise(S.FOREIGN)


def zone_kind(display_type) -> Column:
    return F.when(_c(display_type).isin("ecological-zone", "coral-reef", "fishing-banned"), S.MPA).otherwise(_c(display_type))


def zone_violation(kind, zone_country, vessel_flag) -> Column:
    foreign = (_c(vessel_flag) != 0) & (_c(vessel_flag) != _c(zone_country))
    return F.when(_c(kind) == S.MPA, True).when(_c(kind) == S.EEZ, foreign).otherwise(False)


def implied_kn(dist_m, dt_ms) -> Column:
    kn = _c(dist_m) * 3600.0 / 1852.0 / (F.when(_c(dt_ms) > 0, _c(dt_ms)) / 1000.0)
    return F.coalesce(kn, F.lit(9999.0))


def spoofed(dist_m, dt_ms) -> Column:
    """Over 50 nm within a minute, or over 60 kn for 3 s and longer; never backwards in time."""
    d, dt = _c(dist_m), _c(dt_ms)
    return F.when(dt < 0, False).otherwise(((dt <= 60_000) & (d > 50.0 * 1852.0)) | ((dt >= 3_000) & (implied_kn(d, dt) > 60.0)))


def expected_interval_s(speed_kn) -> Column:
    return F.when(_c(speed_kn) <= 14, 10.0).when(_c(speed_kn) <= 23, 6.0).otherwise(2.0)


def silence_threshold_s(speed_kn, settings: S.Settings) -> Column:
    """Silence in event seconds from which a vessel is dark."""
    formula = expected_interval_s(speed_kn) * settings.silence_mult
    return F.greatest(formula, F.lit(float(settings.min_silence_s))) * float(settings.playback_speed)


def round1(x) -> Column:
    """To a tenth, by adding half and cutting off."""
    return (_c(x) * 10 + 0.5).cast("long") / 10.0


def round1_away(x) -> Column:
    return F.round(_c(x) * 10) / 10.0


def heading_delta(before, now) -> Column:
    d = _c(now) - _c(before)
    return F.when(d > 180, d - 360.0).when(d < -180, d + 360.0).otherwise(d)


def course_std(mean_sin, mean_cos) -> Column:
    r = F.sqrt(_c(mean_sin) * _c(mean_sin) + _c(mean_cos) * _c(mean_cos))
    return F.when(r <= 0, 180.0).when(r >= 1, 0.0).otherwise(F.degrees(F.sqrt(-2.0 * F.ln(r))))


def decay(age_ms, half_life_ms: int) -> Column:
    return F.when(_c(age_ms) <= 0, 1.0).otherwise(F.pow(F.lit(2.0), -_c(age_ms) / float(half_life_ms)))


def points(base, age_ms, half_life_ms: int) -> Column:
    return F.round(_c(base) * decay(age_ms, half_life_ms)).cast("int")


def tier(score) -> Column:
    s = _c(score)
    return F.when(s >= 85, "CRITICAL").when(s >= 65, "HIGH").when(s >= 40, "ELEVATED").otherwise("LOW")


def tier_rank(name) -> Column:
    out = F.lit(0)
    for k, v in (("ELEVATED", 1), ("HIGH", 2), ("CRITICAL", 3)):
        out = F.when(_c(name) == k, v).otherwise(out)
    return out


def crossed_up_to(before, now, want: str) -> Column:
    """Whether the tier rose to ``want`` or beyond from below it; null before is the lowest."""
    return (tier_rank(now) >= tier_rank(F.lit(want))) & (tier_rank(before) < tier_rank(F.lit(want)))


def severity(score) -> Column:
    return F.when(_c(score) >= 85, "CRITICAL").otherwise("HIGH")


def weather_confidence(kind, wave_m) -> Column:
    """LOW: the sea explains the track; HIGH: it doesn't; empty: no saying."""
    k, w = _c(kind), _c(wave_m)
    rough = F.when(k == S.TRAWLING, w >= 2.0).when(k == S.LONGLINING, w >= 2.5).otherwise(False)
    return F.when(rough, "LOW").when(k.isin(S.TRAWLING, S.LONGLINING) & (w < 0.8), "HIGH").otherwise("")


def feed_code(kind) -> Column:
    out = F.lit(5)
    for i, k in enumerate((S.ZONE_VIOLATION, S.SPOOF, S.DARK, S.SUSPECTED, S.BOARDING)):
        out = F.when(_c(kind) == k, i).otherwise(out)
    return out


def feed_cooldown_ms(kind) -> Column:
    return F.when(_c(kind) == S.SPOOF, 90_000).otherwise(20_000).cast("long")


def alert_id(number) -> Column:
    return F.format_string("a-%06d", _c(number))


def whole(x) -> Column:
    """A number as text without decimals, halves to even."""
    return F.bround(_c(x), 0).cast("long").cast("string")


def hist_bucket(us) -> Column:
    """Which power of two a latency is in, 0 to 31."""
    log = F.floor(F.log2(F.when(_c(us) >= 1, _c(us)))).cast("int")
    return F.least(F.lit(31), F.coalesce(log, F.lit(0)))


def runner_name(mmsi) -> Column:
    return F.when(_c(mmsi) >= 420_000_000, F.concat(F.lit("RUNNER-"), (_c(mmsi) - 420_000_000).cast("string")))


def point_feature(mmsi, lat, lon, speed_kn, heading_deg, **extra: Column) -> Column:
    """A GeoJSON point of a vessel; null extras are left out when written as JSON."""
    about = {"mmsi": mmsi, "speed_kn": speed_kn, "heading_deg": heading_deg} | extra
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(_c(lon), _c(lat)).alias("coordinates")).alias("geometry"),
        F.struct(*[_c(v).alias(k) for k, v in about.items()]).alias("properties"),
    )


# --- how the dashboard words things ---------------------------------------------------------------


def is_major(severity_col="severity") -> Column:
    return _c(severity_col).isin("HIGH", "CRITICAL")


def is_alert_tab(kind="kind", severity_col="severity") -> Column:
    return (_c(kind) == S.ZONE_VIOLATION) & is_major(severity_col)


def severity_weight(name) -> Column:
    out = F.lit(0)
    for k, v in (("MEDIUM", 1), ("HIGH", 2), ("CRITICAL", 3)):
        out = F.when(_c(name) == k, v).otherwise(out)
    return out


def compact(n) -> Column:
    x = _c(n).cast("double")
    return (
        F.when(x.isNull(), "—")
        .when(x >= 1e6, F.format_string("%.1fM", x / 1e6))
        .when(x >= 1e3, F.format_string("%.1fk", x / 1e3))
        .otherwise(F.floor(x + 0.5).cast("string"))
    )


def detail_line(kind, detail, zone_id) -> Column:
    k, d, z = _c(kind), _c(detail), F.coalesce(_c(zone_id), F.lit(""))
    n = lambda x: F.floor(F.coalesce(x, F.lit(0.0)) + 0.5).cast("string")
    sea = F.when(d["sea_state_m"].isNotNull(), F.concat(F.lit(" · sea "), d["sea_state_m"].cast("string"), F.lit(" m"))).otherwise("")
    return (
        F.when(k == S.SPOOF, F.concat(F.lit("implied "), n(d["implied_speed_kn"]), F.lit(" kn")))
        .when(k == S.DARK, F.concat(F.lit("silent "), n(d["silence_s"]), F.lit(" s · "), z))
        .when(d["pattern"].isNotNull(), F.concat(d["pattern"], sea))
        .otherwise(z)
    )


def ago_suffix(updated_ms, now_ms) -> Column:
    mins = F.greatest(F.lit(0), F.floor((_c(now_ms) - _c(updated_ms)) / 60_000.0 + 0.5))
    said = F.when(mins <= 0, " · updated now").otherwise(F.concat(F.lit(" · updated "), mins.cast("string"), F.lit("m ago")))
    return F.when(F.coalesce(_c(updated_ms), F.lit(0)) == 0, "").otherwise(said)


def bar_percent(us, most) -> Column:
    return F.greatest(F.lit(2.0), F.least(F.lit(100.0), F.coalesce(F.try_divide(_c(us), _c(most)) * 100, F.lit(0.0))))


def tier_color(name) -> Column:
    # The dashboard's colours.
    colors = {"LOW": "#3e5c76", "ELEVATED": "#d99000", "HIGH": "#e8791a", "CRITICAL": "#e11d1d"}
    out = F.lit(colors["LOW"])
    for k, v in colors.items():
        out = F.when(_c(name) == k, v).otherwise(out)
    return out

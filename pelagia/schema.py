"""Tables of the engine and the numbers that its rules use."""

from __future__ import annotations

from dataclasses import dataclass

FIX = "mmsi LONG, lat DOUBLE, lon DOUBLE, speed_kn DOUBLE, heading_deg DOUBLE, ts_ms LONG, flag_code INT, seq LONG"
ZONE = (
    "zone_idx INT, zone_id STRING, zone_name STRING, display_type STRING, zone_kind STRING, country_code INT, "
    "min_lon DOUBLE, max_lon DOUBLE, min_lat DOUBLE, max_lat DOUBLE, rings ARRAY<ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>>"
)
PATROL = "patrol_idx INT, patrol_id STRING, patrol_name STRING, lat DOUBLE, lon DOUBLE, max_speed_kn DOUBLE"
NAME = "mmsi LONG, name STRING"
WEATHER = "wave_m DOUBLE, updated_ms LONG, ok BOOLEAN"
CONE = "STRUCT<lat: DOUBLE, lon: DOUBLE, heading_deg: DOUBLE, spread_deg: DOUBLE, radius_m: DOUBLE>"
INTERCEPTS = "ARRAY<STRUCT<patrol_id: STRING, heading_deg: DOUBLE, eta_s: DOUBLE, feasible: BOOLEAN>>"
FACTORS = "ARRAY<STRUCT<code: STRING, label: STRING, points: INT, ts_ms: LONG>>"
DETAIL = (
    "STRUCT<zone_kind: STRING, implied_speed_kn: DOUBLE, pattern: STRING, sea_state_m: DOUBLE, weather_confidence: STRING, "
    "silence_s: DOUBLE, tier: STRING>"
)

# Kinds of alerts. BOARDING is reserved and never raised.
ZONE_VIOLATION, SPOOF, DARK = "ZONE_VIOLATION", "SPOOF_TELEPORT", "DARK_EVENT"
TRAWLING, LONGLINING, SEINING = "TRAWLING", "LONGLINING", "PURSE_SEINING"
SUSPECTED, BOARDING = "ILLEGAL_FISHING_SUSPECTED", "BOARDING_RECOMMENDED"
FISHING_KINDS = (TRAWLING, LONGLINING, SEINING)
MPA, EEZ = "mpa", "eez"
# Flag and country codes; 0 is unknown and 255 some other country.
COUNTRY = {"IN": 1, "LK": 2, "NL": 3, "DK": 4}
FOREIGN = 255


@dataclass(frozen=True)
class Settings:
    """What a run can vary; the defaults are the rules' own numbers."""

    # darkness
    silence_mult: float = 6.0
    min_silence_s: float = 0.0
    playback_speed: float = 1.0
    dark_min_speed_kn: float = 1.0
    dark_near_nm: float = 5.0
    cone_r0_m: float = 100.0
    cone_spread_deg: float = 30.0
    #: End of observation in event time; None watches forever, so every vessel's last fix ages without bound.
    as_of_ms: int | None = None
    # fishing
    history: int = 16
    debounce_ms: int = 1_800_000
    # risk
    window_ms: int = 48 * 3_600_000
    half_life_ms: int = 24 * 3_600_000
    max_dark: int = 16
    sweep_ms: int = 5_000
    # weather
    weather_stale_ms: int = 30 * 60_000
    # feed
    feed_cap: int = 25
    feed_tick_ms: int = 1_000
    max_positions: int = 3_000
    # spatial
    cell_deg: float = 0.05
    #: Zones that may be compiled into one expression; more go through a join on grid cells.
    inline_zones: int = 64
    #: Zones whose distance may be measured from every silent fix; more are looked up by grid cells.
    near_zones: int = 512


LIVE = Settings(silence_mult=10.0, min_silence_s=900.0)

"""The demonstration engine as SQL common table expressions, for DuckDB."""

from __future__ import annotations

from pelagia.plans.demo import EVENTS_AS_FIXES, PATROLS, SETTINGS, WEATHER_N, WEATHER_START_MS, WEATHER_STEP_MS, ZONES
from pelagia.schema import COUNTRY

_KIND = {"ecological-zone": "mpa", "coral-reef": "mpa", "fishing-banned": "mpa"}
M, NM = "111320.0", "1852.0"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    q = lambda v: "'" + v + "'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ")"


def _zones() -> str:
    rows = []
    for k, (i, n, t, c, rings) in enumerate(ZONES):
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        rows.append((k, i, n, _KIND.get(t, t), COUNTRY.get(c or "", 0), min(xs), max(xs), min(ys), max(ys)))
    return _values("zones", "zone_idx, zone_id, zone_name, zone_kind, country_code, min_lon, max_lon, min_lat, max_lat", rows)


def _edges() -> str:
    rows = [(k, *map(float, (*a, *b))) for k, z in enumerate(ZONES) for r in z[4] for a, b in zip(r, r[1:])]
    return _values("edges", "zone_idx, x1, y1, x2, y2", rows)


FIXES = f"""fixes AS (SELECT mmsi, lat, lon, speed_kn, heading_deg, ts_ms,
  CASE WHEN mmsi // 1000000 IN (219, 220) THEN 4 WHEN mmsi // 1000000 BETWEEN 244 AND 246 THEN 3 ELSE 255 END AS flag_code, seq
  FROM (SELECT {", ".join(f"{v} AS {k}" for k, v in EVENTS_AS_FIXES.items())}, epoch_us(ts) // 1000 AS ts_ms FROM events))"""

DIMENSIONS = f"{_zones()}, {_edges()}, {_values('patrols', 'patrol_idx, patrol_id, p_lat, p_lon, p_kn', [(k, p[0], *p[2:]) for k, p in enumerate(PATROLS)])}"

MEMBER = """member AS (SELECT mmsi, seq, zone_idx, zone_id, zone_kind, country_code FROM (
  SELECT f.mmsi, f.seq, z.zone_idx, z.zone_id, z.zone_kind, z.country_code,
    bool_or((lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS edge,
    count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * ((lat - y1) / (y2 - y1)) + x1) % 2 = 1 AS odd
  FROM fixes f JOIN zones z ON lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat JOIN edges e ON e.zone_idx = z.zone_idx
  GROUP BY ALL) WHERE edge OR odd)"""

# distance of positions in table `at` (columns mmsi, seq, lat, lon) to each zone
def distance(at: str) -> str:
    return f"""dist AS (SELECT d.mmsi, d.seq, d.zone_idx, z.zone_id, z.zone_kind, CASE WHEN m.zone_idx IS NOT NULL THEN 0 ELSE meters / {NM} END AS nm FROM (
  SELECT mmsi, seq, zone_idx, min(sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy))) AS meters FROM (
    SELECT *, greatest(0, least(1, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE (-ax * dx - ay * dy) / (dx * dx + dy * dy) END)) AS t FROM (
      SELECT mmsi, seq, zone_idx, (x1 - lon) * {M} * cos(radians(lat)) AS ax, (y1 - lat) * {M} AS ay,
        (x2 - x1) * {M} * cos(radians(lat)) AS dx, (y2 - y1) * {M} AS dy FROM {at} CROSS JOIN edges)) GROUP BY ALL) d
  JOIN zones z USING (zone_idx) LEFT JOIN member m USING (mmsi, seq, zone_idx))"""


def violation(kind: str, country: str, flag: str) -> str:
    return f"({kind} = 'mpa' OR ({kind} = 'eez' AND {flag} <> 0 AND {flag} <> {country}))"


W = "PARTITION BY mmsi ORDER BY ts_ms, seq"
TRACKED = f"""fz AS (SELECT f.*, coalesce(zs, []) AS zs, coalesce(bad, false) AS bad FROM fixes f LEFT JOIN (
    SELECT mmsi, seq, list(zone_idx ORDER BY zone_idx) AS zs, bool_or({violation("zone_kind", "country_code", "flag_code")}) AS bad
    FROM member JOIN fixes USING (mmsi, seq) GROUP BY ALL) USING (mmsi, seq)),
tracked AS (SELECT *, lag(ts_ms) OVER w AS p_ts, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(zs) OVER w AS p_zs, lead(ts_ms) OVER w AS n_ts,
    coalesce(list({{'ts': ts_ms, 's': speed_kn, 'h': heading_deg}}) OVER (w ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING), []) AS hist
  FROM fz WINDOW w AS ({W}))"""

# the ring's measures, for rows with one
MEASURED = """ring AS (SELECT *, [x.s FOR x IN hist] AS sp, [x.h FOR x IN hist] AS hd FROM tracked WHERE len(hist) > 0),
measured AS (SELECT *, len(sp) AS n, list_min(sp) AS min_kn, list_max(sp) AS max_kn, list_sum(sp) / len(sp) AS avg_kn, sp[1] AS first_kn, sp[-1] AS last_kn,
    list_sum([sin(radians(h)) FOR h IN hd]) / len(hd) AS ms, list_sum([cos(radians(h)) FOR h IN hd]) / len(hd) AS mc,
    coalesce(list_sum([CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END FOR d IN [hd[i + 1] - hd[i] FOR i IN range(1, len(hd))]]), 0) AS rot,
    CAST(list_reduce(sp, lambda a, s: CASE WHEN a % 2 = 1 AND s <= 3.0 THEN a + 1 WHEN a % 2 = 0 AND s >= 6.0 THEN a + 3 ELSE a END, CASE WHEN sp[1] >= 4.5 THEN 1.0 ELSE 0.0 END) AS INT) // 2 AS crossings
  FROM ring),
spread AS (SELECT *, sqrt(ms * ms + mc * mc) AS r, CASE WHEN sqrt(ms * ms + mc * mc) <= 0 THEN 180.0 WHEN sqrt(ms * ms + mc * mc) >= 1 THEN 0.0
    ELSE degrees(sqrt(-2 * ln(sqrt(ms * ms + mc * mc)))) END AS std FROM measured)"""

FISHING = """gear AS (SELECT *, CASE WHEN n < 8 THEN NULL
    WHEN n >= 10 AND abs(rot) >= 270 AND max_kn > 7 AND first_kn > 5 AND last_kn <= 2.5 THEN 'PURSE_SEINING'
    WHEN n >= 12 AND crossings >= 3 AND max_kn >= 7 AND min_kn <= 2.5 AND std < 20 THEN 'LONGLINING'
    WHEN n >= 12 AND min_kn >= 1 AND max_kn <= 5.5 AND avg_kn BETWEEN 2 AND 4.5 AND std > 25 THEN 'TRAWLING' END AS kind FROM spread WHERE bad AND p_ts IS NOT NULL),
cand AS (SELECT *, CASE kind WHEN 'PURSE_SEINING' THEN round_even(abs(rot), 0)::BIGINT::VARCHAR || ' deg net loop then stop'
    WHEN 'LONGLINING' THEN 'sawtooth speed, ' || crossings::VARCHAR || ' fast/slow cycles on a straight track'
    ELSE 'slow 2.0-4.5 kn with course spread ' || round_even(std, 0)::BIGINT::VARCHAR || ' deg (trawl-like)' END AS pattern,
    row_number() OVER (PARTITION BY mmsi ORDER BY ts_ms, seq) AS k FROM gear WHERE kind IS NOT NULL),
spaced AS (SELECT mmsi, seq, k, ts_ms FROM cand WHERE k = 1
  UNION ALL SELECT mmsi, seq, k, ts_ms FROM (
    SELECT c.mmsi, c.seq, c.k, c.ts_ms, row_number() OVER (PARTITION BY c.mmsi ORDER BY c.k) AS pick FROM spaced s JOIN cand c ON c.mmsi = s.mmsi AND c.k > s.k AND c.ts_ms - s.ts_ms > 1800000) WHERE pick = 1),
fishing AS (SELECT c.* FROM cand c JOIN spaced s USING (mmsi, seq))"""

THRESHOLD = f"CASE WHEN speed_kn <= 14 THEN 10.0 WHEN speed_kn <= 23 THEN 6.0 ELSE 2.0 END * {SETTINGS.silence_mult} * {SETTINGS.playback_speed}"
SILENT = f"""silent AS (SELECT *, {THRESHOLD} AS silence_s, ts_ms + CAST(ceil({THRESHOLD} * 1000) AS BIGINT) AS detect_ms FROM tracked
  WHERE speed_kn > 1 AND (coalesce(n_ts, {SETTINGS.as_of_ms}) - ts_ms) / 1000.0 > {THRESHOLD})"""
DARK = f"""{distance("silent")},
dark AS (SELECT s.*, d.near_id FROM silent s JOIN (
  SELECT mmsi, seq, min(nm) AS nm, arg_min(zone_id, (nm, zone_idx)) AS near_id FROM dist WHERE zone_kind <> 'eez' GROUP BY ALL) d USING (mmsi, seq) WHERE d.nm <= 5)"""

DIST_M = f"sqrt(pow((lat - p_lat) * {M}, 2) + pow((lon - p_lon) * {M} * cos(radians((p_lat + lat) / 2.0)), 2))"
KN = f"CASE WHEN ts_ms > p_ts THEN {DIST_M} * 3600.0 / {NM} / ((ts_ms - p_ts) / 1000.0) ELSE 9999.0 END"
ZONE_SPOOF = f"""zv AS (SELECT t.*, z.zone_id, z.zone_kind, z.zone_idx FROM (SELECT *, unnest(zs) AS zi FROM tracked WHERE p_ts IS NOT NULL) t JOIN zones z ON z.zone_idx = t.zi
  WHERE NOT list_contains(p_zs, zi) AND {violation("zone_kind", "country_code", "flag_code")}),
sp AS (SELECT *, {KN} AS kn FROM tracked WHERE p_ts <> 0 AND ts_ms >= p_ts AND ((ts_ms - p_ts <= 60000 AND {DIST_M} > 50.0 * {NM}) OR (ts_ms - p_ts >= 3000 AND {KN} > 60.0)))"""

EVENTS = """found AS (
  SELECT 'ZONE_VIOLATION' AS kind, mmsi, ts_ms AS at_ms, zone_idx AS rank, ts_ms, seq, lat, lon, zone_id, NULL::DOUBLE AS kn, NULL::VARCHAR AS pattern FROM zv
  UNION ALL SELECT 'SPOOF_TELEPORT', mmsi, ts_ms, 1000000, ts_ms, seq, lat, lon, '', kn, NULL FROM sp
  UNION ALL SELECT kind, mmsi, ts_ms, 2000000, ts_ms, seq, lat, lon, '', NULL, pattern FROM fishing
  UNION ALL SELECT 'DARK_EVENT', mmsi, detect_ms, 3000000, ts_ms, seq, lat, lon, near_id, NULL, NULL FROM dark),
state AS (SELECT *, max(at_ms) FILTER (kind = 'ZONE_VIOLATION') OVER run AS zone_ms, max(at_ms) FILTER (kind = 'SPOOF_TELEPORT') OVER run AS spoof_ms,
    max(at_ms) FILTER (kind IN ('TRAWLING', 'LONGLINING', 'PURSE_SEINING')) OVER run AS fish_ms,
    list(at_ms) FILTER (kind = 'DARK_EVENT') OVER run AS darks FROM found
  WINDOW run AS (PARTITION BY mmsi ORDER BY at_ms, rank, seq ROWS UNBOUNDED PRECEDING))"""


def points(base: str, at: str, now: str) -> str:
    return f"CASE WHEN {at} IS NOT NULL AND {at} <> 0 AND {now} - {at} <= 172800000 THEN CAST(round(({base}) * CASE WHEN {now} <= {at} THEN 1.0 ELSE pow(2.0, -({now} - {at}) / 86400000.0) END) AS INT) ELSE 0 END"


def score(now: str, prefix: str = "") -> str:
    """Score of a row of state at a time."""
    p = prefix
    kept = f"list_filter(coalesce({p}darks[-16:], []), lambda t: {now} - t <= 172800000)"
    return f"least(100, {points('90', p + 'zone_ms', now)} + {points(f'15 + 10 * (len({kept}) - 1)', f'{kept}[-1]', now)} + {points('15', p + 'spoof_ms', now)} + {points('20', p + 'fish_ms', now)})"


TIER = "CASE WHEN score >= 85 THEN 'CRITICAL' WHEN score >= 65 THEN 'HIGH' WHEN score >= 40 THEN 'ELEVATED' ELSE 'LOW' END"
SCORED = f"""scored AS (SELECT *, CASE WHEN kind IN ('TRAWLING', 'LONGLINING', 'PURSE_SEINING') AND score < 85 THEN 'MEDIUM' WHEN score >= 85 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
  FROM (SELECT *, {score("at_ms")} AS score FROM state))"""
SWEEPS = f"""last_of AS (SELECT mmsi, CAST(ceil(at_ms / 5000.0) AS BIGINT) * 5000 AS sweep_ms, zone_ms, spoof_ms, fish_ms, darks FROM state
  QUALIFY row_number() OVER (PARTITION BY mmsi, CAST(ceil(at_ms / 5000.0) AS BIGINT) ORDER BY at_ms DESC, rank DESC, seq DESC) = 1),
was AS (SELECT *, lag(sweep_ms) OVER v IS NOT NULL AS known, lag(zone_ms) OVER v AS w_zone_ms, lag(spoof_ms) OVER v AS w_spoof_ms, lag(fish_ms) OVER v AS w_fish_ms, lag(darks) OVER v AS w_darks
  FROM last_of WINDOW v AS (PARTITION BY mmsi ORDER BY sweep_ms)),
swept AS (SELECT mmsi, sweep_ms, {score("sweep_ms")} AS score, CASE WHEN known THEN {score("(sweep_ms - 5000)", "w_")} END AS before FROM was)"""
WEATHER = f"weather AS (SELECT (range % 7) * 0.5 AS wave_m, {WEATHER_START_MS} + range * {WEATHER_STEP_MS} AS updated_ms FROM range({WEATHER_N}))"

_ORDER = ["fixes", "dims", "member", "tracked", "measured", "fishing", "silent", "dark", "zone_spoof", "events", "scored", "sweeps"]
_TEXT = dict(zip(_ORDER, (FIXES, DIMENSIONS, MEMBER, TRACKED, MEASURED, FISHING, SILENT, DARK, ZONE_SPOOF, EVENTS, SCORED, SWEEPS), strict=True))


def upto(last: str, body: str, *more: str) -> str:
    """A query over the expressions up to a step."""
    steps = _ORDER[: _ORDER.index(last) + 1]
    return "WITH RECURSIVE " + ",\n".join([*(_TEXT[s] for s in steps), *more]) + "\n" + body

import json

import pytest

from pelagia.plans import demo
from pelagia.sources import dimensions, fixes


def test_csv(spark, tmp_path):
    rows = [
        "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,Navigational status,ROT,SOG,COG,Heading,IMO,Callsign,Name,Ship type",
        "27/02/2025 00:00:01,Class A,219000001,55.5,11.25,x,,12.5,100,511,,,SHIP A,Cargo",
        "27/02/2025 00:00:02,Class B, 244000002 , 55.6,11.3,x,,102.3,400,360,,, SHIP B ,",
        "27/02/2025 00:00:03,Base Station,219000001,55.5,11.25,x,,1,1,1,,,N,",
        "27/02/2025 00:00:03,Class A ,219000001,55.5,11.25,x,,1,1,1,,,N,",
        "27/02/2025 00:00:03,Class A,0,55.5,11.25,x,,1,1,1,,,N,", "27/02/2025 00:00:03,Class A,x,55.5,11.25,x,,1,1,1,,,N,",
        "27/02/2025 00:00:03,Class A,1,91,181,x,,1,1,1,,,N,", "27/02/2025 00:00:03,Class A,1,0,0,x,,1,1,1,,,N,", "27/02/2025 00:00:03,Class A,1,NaN,5,x,,1,1,1,,,N,",
        "2025-02-27 00:00:03,Class A,1,55,11,x,,1,1,1,,,N,", "27/02/2025 00:00:04,Class A,1,55,11,x", "",
        "27/02/2025 00:00:05,Class A,5000000000,55,11,x,,1,1,1,,,N,", "27/02/2025 00:00:06,Class A,7,55,11,x,,-3,,,,,,",
    ]
    (tmp_path / "a.csv").write_text("\n".join(rows))
    got = fixes.read_csv(spark, str(tmp_path / "a.csv")).orderBy("ts_ms").collect()
    assert [(r.mmsi, r.speed_kn, r.heading_deg, r.flag_code, r.name, r.ts_ms % 60_000) for r in got] == [
        (219000001, 12.5, 100.0, 4, "SHIP A", 1000), (244000002, 0.0, 0.0, 3, "SHIP B", 2000), (7, 0.0, 0.0, 255, "", 6000),
    ]
    assert [r.mmsi for r in fixes.read_csv(spark, str(tmp_path / "a.csv"), limit=2).collect()] == [219000001, 244000002]
    q = fixes.stream_csv(spark, str(tmp_path)).writeStream.format("memory").queryName("csv_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("csv_rows").count() == 3


def frame(kind="PositionReport", **body):
    meta = {"MMSI": 244000001, "ShipName": " BOAT ", "latitude": 52.0, "longitude": 4.0, "time_utc": ""} | body.pop("meta", {})
    return json.dumps({"MessageType": kind, "MetaData": meta, "Message": {kind: body}})


def test_live(spark):
    lines = [
        frame(UserID=219000001, Sog=3.5, Cog=45.0, TrueHeading=511, Latitude=55.0, Longitude=11.0),
        frame(UserID=0, Sog=102.3, Cog=400.0, TrueHeading=511, Latitude=0.0, Longitude=0.0),
        frame(UserID=0, meta={"MMSI": 0}, Latitude=55.0, Longitude=11.0), frame(UserID=1, Latitude=91.0, Longitude=181.0),
        frame("ShipStaticData", UserID=219000001, Name=" THE NAME "), "{broken", json.dumps({"MessageType": "PositionReport", "MetaData": {}, "Message": {}}),
    ]
    from pyspark.sql import functions as F

    decoded = fixes.decode_live(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value STRING, at LONG"), received_ms=F.col("at"))
    got = sorted((r.mmsi, r.lat, r.lon, r.speed_kn, r.heading_deg, r.ts_ms, r.flag_code, r.name) for r in fixes.normalize_live(decoded).collect())
    assert got == [(219000001, 55.0, 11.0, 3.5, 45.0, 0, 4, "BOAT"), (244000001, 52.0, 4.0, 0.0, 0.0, 1, 3, "BOAT")]
    names = {r.mmsi: r.name for r in fixes.latest_names(fixes.live_names(decoded), "received_ms").collect()}
    assert names[219000001] == "THE NAME"
    assert fixes.in_box(fixes.normalize_live(decoded), 51, 2, 54, 7).count() == 1


def test_scenario(spark):
    text = json.dumps({"name": "n", "speed": 0, "vessels": [{"mmsi": 1, "name": "A", "flag": "DK"}], "frames": [
        {"t_ms": 10, "mmsi": 1, "lat": 1.0, "lon": 2.0, "speed_kn": 3.1, "heading_deg": 4}, {"t_ms": 10, "mmsi": 2, "lat": 1.0, "lon": 2.0, "speed_kn": 3, "heading_deg": 4}]})
    rows, names, speed = fixes.scenario_of_text(spark, text)
    got = sorted((r.seq, r.mmsi, r.flag_code, r.ts_ms, round(r.speed_kn, 5)) for r in rows.collect())
    assert got == [(0, 1, 4, 1720000000010, 3.1), (1, 2, 0, 1720000000010, 3.0)] and speed == 1.0 and names.first().name == "A"
    assert got[0][4] != rows.where("seq = 0").first().speed_kn  # held in single precision
    with pytest.raises(ValueError):
        fixes.scenario_of_text(spark, '{"frames": []}')


def test_zones(spark):
    doc = json.loads(demo.geojson())
    doc["features"].insert(1, {"properties": {"id": "line"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}})
    doc["features"].append({"properties": {"id": "multi", "type": "eez", "country": "NL"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}})
    z = dimensions.zones_of_text(spark, json.dumps(doc)).orderBy("zone_idx").collect()
    assert [r.zone_idx for r in z] == list(range(8)) and z[1].zone_id == "belt" and z[1].zone_kind == "mpa"
    assert (z[7].zone_id, z[7].zone_name, z[7].country_code, z[7].max_lon, len(z[7].rings)) == ("multi", "", 3, 1.0, 1)
    with pytest.raises(ValueError):
        dimensions.zones_of_text(spark, '{"features": []}')
    assert dimensions.zone_edges(demo.zones(spark)).where("zone_id = 'reef'").count() == 8


def test_patrols_weather_and_modes(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"patrols": [{"id": "P1", "name": "x", "lat": 1, "lon": 2, "max_speed_kn": 3}]}))
    assert dimensions.load_patrols(spark, str(tmp_path / "p.json")).first().patrol_id == "P1"
    (tmp_path / "none.json").write_text('{"patrols": []}')
    with pytest.raises(ValueError):
        dimensions.load_patrols(spark, str(tmp_path / "none.json"))
    (tmp_path / "w.json").write_text('{"wave_m": 1.0, "updated_ms": 5, "ok": true}\n{"wave_m": 2.0, "updated_ms": 9, "ok": false}\n')
    w = dimensions.load_weather(spark, str(tmp_path / "w.json"))
    assert tuple(dimensions.latest_weather(w).first()) == (1.0, 5, True) and tuple(dimensions.latest_weather(w.limit(0)).first()) == (0.0, 0, False)
    m = dimensions.choose_mode
    assert [m().source, m(firehose=True, csv="x").source, m(scenario="s", csv="x").source, m(fake=True, scenario="s").source] == ["live", "csv", "scenario", "fake"]
    assert (m(csv="x").zones, m().patrols, m(scenario="a-trawling.json").region, m(zones="own").zones) == ("zones-denmark.geojson", "patrol-northsea.json", "denmark", "own")


def test_generators(spark):
    rows = fixes.firehose(spark, 100_000)
    assert rows.select("mmsi").distinct().count() == 98_000 + 64
    assert fixes.runner_names(rows).count() == 64
    frames = fixes.fake_frames(spark, 9).collect()
    kinds = [json.loads(r.frame)["type"] for r in frames]
    assert (kinds.count("metrics"), kinds.count("alert"), kinds.count("positions")) == (9, 3, 18)
    told = [json.loads(r.frame)["alert"] for r in frames if '"alert"' in r.frame]
    assert [a["kind"] for a in told] == ["ZONE_VIOLATION", "SPOOF_TELEPORT", "DARK_EVENT"] and "cone" not in told[0] and told[2]["cone"]["heading_deg"] == 210

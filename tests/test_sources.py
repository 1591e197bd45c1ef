"""Readers on the FIXTURES.md inline rows."""

import pytest

from cirro.sources import readers as RD


def test_metar_fixture(spark):
    rows = [("FYWH 161200Z 18005KT CAVOK 25/10 Q1015",),            # no rain token
            ("FYWH 161200Z 18005KT -RA BKN020",),                   # rain, no amount
            ("KXYZ 161200Z 18005KT RA OVC010 RMK AO2 P0012",),      # P-code
            ("KXYZ 161200Z 18005KT RA OVC010 RMK AO2 60024",),      # 6-hour group in remarks
            ("FYRA 161200Z 18005KT -RA SCT030",)]                   # time group must not read as 304.8 mm
    df = spark.createDataFrame(rows, "raw string")
    got = [r["precipitation"] for r in RD.precip_from_metar(df).collect()]
    assert got == pytest.approx([0.0, 0.5, 12 * 0.254, 24 * 0.254 / 6, 0.5])


def test_observation_fixture(spark):
    docs = [
        '{"properties": {"precipitationLastHour": {"value": 0.002}}}',
        '{"properties": {"precipitationLast3Hours": {"value": 0.003}}}',
        '{"properties": {"precipitationLast6Hours": {"value": 0.006}}}',
        '{"properties": {"textDescription": "Light Rain"}}',
        '{"properties": {"precipitationLastHour": {"value": null}, "rawMessage": null}}',
    ]
    df = spark.createDataFrame([(d,) for d in docs], "obs string")
    got = [r["precipitation"] for r in RD.precip_from_observation(df, "obs", unit="m").collect()]
    assert got == pytest.approx([2.0, 1.0, 1.0, 0.5, 0.0])


def test_stations_fixture(spark):
    rows = [("FYWH", -22.4867, 17.4708, "Windhoek Hosea Kutako"), ("AO-0037", -12.0, 18.0, "Calai"),
            ("FYGF", None, 18.1227, "Grootfontein"), (" fylz ", -26.6874, 15.2429, "Luderitz")]
    df = spark.createDataFrame(rows, "ident string, latitude_deg double, longitude_deg double, name string")
    out = RD.valid_stations(RD.normalize_stations(df)).orderBy("station_id").collect()
    assert [r["station_id"] for r in out] == ["FYLZ", "FYWH"]


def test_hourly_json_fallbacks(spark, tmp_path):
    doc = ('{"location": "x", "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], '
           '"temperature_2m": [20.0, 21.0], "relative_humidity_2m": [50.0, 55.0], '
           '"pressure_msl": [1010.0, 1011.0], "precipitation": [0.0, 0.4]}, '
           '"current": {"temperature_2m": 21.0}}')
    p = tmp_path / "f.json"
    p.write_text(doc + "\n")
    rows = RD.read_hourly_json(spark, str(p)).orderBy("ts").collect()
    assert [r["pressure"] for r in rows] == [1010.0, 1011.0]
    assert [r["cloud_cover"] for r in rows] == [0.0, 0.0]
    assert rows[0]["dewpoint"] is None
    cur = RD.read_current_json(spark, str(p)).collect()[0]
    assert cur["temperature_2m"] == 21.0 and cur["precipitation"] == 0.0


def test_location_dim_and_override(spark):
    loc = RD.location_dim(spark, [(-20.0, 16.5)]).collect()
    assert len(loc) == 6 and loc[-1]["name"] == "Custom (-20.0000, 16.5000)"
    cur = spark.createDataFrame([("a", 0.0), ("b", 0.3)], "k string, precipitation double")
    obs = spark.createDataFrame([("a", 1.2)], "k string, observed double")
    out = {r["k"]: r for r in RD.observed_override(cur, obs, ["k"]).collect()}
    assert out["a"]["precipitation"] == 1.2 and out["a"]["precipitation_source"] == "station"
    assert out["b"]["precipitation_source"] == "model" and out["b"]["raining"] is True

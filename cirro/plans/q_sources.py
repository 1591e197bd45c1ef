"""Driver queries for the readers.

The reference reads landed service documents; the driver's tables are not
such documents.  Each query below first renders table rows into the
document shape the reader expects (JSON text, METAR text, a station
list) -- that step only produces input -- and then runs the reader, which
parses the text exactly as it would parse a landed file.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cirro.plans import views as V
from cirro.plans.registry import register, rounded
from cirro.sources import readers as RD


# --- stand-in documents ---------------------------------------------------------------
def hourly_docs(spark, sf_dir):
    """One forecast JSON document per (series, day) of the hourly view."""
    h = V.ev_hourly(spark, sf_dir)
    day = F.to_date("ts")
    g = h.groupBy("series_id", day.alias("day")).agg(F.sort_array(F.collect_list(
        F.struct("ts", "v_avg", "v_sum", "n", "k_avg"))).alias("a"))
    a = F.col("a")
    hourly = F.struct(
        F.transform(a, lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.transform(a, lambda x: x["k_avg"]).alias("temperature_2m"),
        F.transform(a, lambda x: x["n"].cast("double")).alias("relative_humidity_2m"),
        # some documents carry only the sea-level pressure
        F.when(F.dayofmonth("day") % 2 == 0, F.transform(a, lambda x: x["v_avg"])).alias("surface_pressure"),
        F.transform(a, lambda x: x["v_avg"]).alias("pressure_msl"),
        F.transform(a, lambda x: x["v_sum"] / 1000).alias("precipitation"),
    )
    last = F.element_at(a, -1)
    current = F.struct(last["k_avg"].alias("temperature_2m"),
                       last["n"].cast("double").alias("relative_humidity_2m"),
                       last["v_avg"].alias("surface_pressure"),
                       (last["v_sum"] / 1000).alias("precipitation"))
    return g.select("series_id", F.col("day").cast("timestamp_ntz").alias("day"), F.to_json(F.struct(F.col("series_id").alias("location"),
                                                           hourly.alias("hourly"),
                                                           current.alias("current"))).alias("doc"))


HOURLY_JSON_SQL = rounded(f"""
SELECT series_id, ts, k_avg AS temperature, CAST(n AS DOUBLE) AS humidity, v_avg AS pressure,
  v_sum / 1000 AS precipitation, 0.0 AS cloud_cover, 0.0 AS wind_speed, 0.0 AS wind_direction,
  CAST(NULL AS DOUBLE) AS dewpoint FROM {V.EV_HOURLY_SQL} AS h""", ["series_id", "ts"],
    ["temperature", "humidity", "pressure", "precipitation", "cloud_cover", "wind_speed",
     "wind_direction", "dewpoint"])


@register("read_hourly_json", HOURLY_JSON_SQL)
def q_hourly_json(spark, sf_dir):
    return RD.parse_hourly_text(hourly_docs(spark, sf_dir), "doc", ["series_id"])


CURRENT_SQL = rounded(f"""
SELECT series_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, arg_max(k_avg, ts) AS temperature_2m,
  CAST(arg_max(n, ts) AS DOUBLE) AS relative_humidity_2m, arg_max(v_avg, ts) AS surface_pressure,
  0.0 AS cloud_cover, 0.0 AS wind_speed_10m, 0.0 AS wind_direction_10m, arg_max(v_sum, ts) / 1000 AS precipitation
FROM {V.EV_HOURLY_SQL} AS h GROUP BY series_id, CAST(CAST(ts AS DATE) AS TIMESTAMP)""", ["series_id", "day"],
    [f for f in RD.CURRENT_FIELDS])


@register("read_current_json", CURRENT_SQL)
def q_current(spark, sf_dir):
    docs = hourly_docs(spark, sf_dir)
    parsed = docs.select("series_id", "day", F.from_json("doc", RD.FORECAST_SCHEMA).alias("d"))
    return RD.current_conditions(parsed.select("series_id", "day", "d.current"), ["series_id", "day"])


def station_list(spark, sf_dir):
    """Supplier rows rendered as an airport list with the reference's
    column names.  The id style follows the nation: local codes
    ('AO-<key>'), lower-case codes padded with spaces, or clean codes;
    suppliers with a negative balance have no latitude."""
    s = V.table(spark, sf_dir, "supplier")
    code = F.upper(F.substring(F.md5(F.col("s_name")), 1, 4))
    ident = (F.when(F.col("s_nationkey") < 3, F.concat(F.lit("AO-"), F.col("s_suppkey").cast("string")))
             .when(F.col("s_nationkey") < 6, F.concat(F.lit(" "), F.lower(code), F.lit(" ")))
             .otherwise(code))
    lat = F.when(F.col("s_acctbal") >= 0, (F.col("s_acctbal") % 180) - 90)
    lon = ((F.col("s_suppkey") * 37.7) % 360) - 180
    return s.select(ident.alias("ident"), lat.alias("latitude_deg"), lon.alias("longitude_deg"),
                    F.col("s_name").alias("name"), F.lit("small_airport").alias("type"), "s_suppkey")


_STATIONS_RAW = """(SELECT CASE WHEN s_nationkey < 3 THEN 'AO-' || CAST(s_suppkey AS VARCHAR)
    WHEN s_nationkey < 6 THEN ' ' || lower(upper(substr(md5(s_name), 1, 4))) || ' '
    ELSE upper(substr(md5(s_name), 1, 4)) END AS ident,
  CASE WHEN s_acctbal >= 0 THEN (s_acctbal % 180) - 90 END AS lat, ((s_suppkey * 37.7) % 360) - 180 AS lon,
  s_name AS name, 'small_airport' AS type, s_suppkey FROM supplier)"""
STATIONS_SQL_INNER = f"""SELECT upper(trim(ident)) AS station_id, name, lat, lon, type, s_suppkey FROM {_STATIONS_RAW} AS r
WHERE length(upper(trim(ident))) = 4 AND lat IS NOT NULL AND lon IS NOT NULL"""
STATIONS_SQL = rounded(STATIONS_SQL_INNER, ["station_id", "name", "type", "s_suppkey"], ["lat", "lon"])


def stations(spark, sf_dir):
    raw = station_list(spark, sf_dir)
    return RD.valid_stations(RD.normalize_stations(raw, keep=["s_suppkey"]), keep=["s_suppkey"])


@register("valid_stations", STATIONS_SQL)
def q_stations(spark, sf_dir):
    return stations(spark, sf_dir)


# --- S6: observation JSON rendered from events ----------------------------------------
def observation_docs(spark, sf_dir):
    """One observation document per event; which fields are present
    depends on the event type (1 h, 3 h, 6 h amount, text only, none)."""
    ev = V.table(spark, sf_dir, "events")
    metres = F.struct((F.col("value") / 1000).alias("value"))
    props = F.struct(
        F.when(F.col("event_type") == "click", metres).alias("precipitationLastHour"),
        F.when(F.col("event_type") == "view", metres).alias("precipitationLast3Hours"),
        F.when(F.col("event_type") == "purchase", metres).alias("precipitationLast6Hours"),
        F.concat(F.lit("METAR K"), F.upper(F.substring(F.md5(F.col("user_id").cast("string")), 1, 3)),
                 F.lit(" "), F.date_format("ts", "ddHHmm"), F.lit("Z FEW030")).alias("rawMessage"),
        F.when(F.col("event_type") == "signup", F.lit("Light Rain"))
         .otherwise(F.lit("Partly Cloudy")).alias("textDescription"))
    return ev.select("event_id", F.to_json(F.struct(props.alias("properties"))).alias("obs"))


OBS_SQL = rounded("""
SELECT event_id, CASE event_type WHEN 'click' THEN value / 1000 * 1000 WHEN 'view' THEN value / 1000 * 1000 / 3
  WHEN 'purchase' THEN value / 1000 * 1000 / 6 WHEN 'signup' THEN 0.5 ELSE 0.0 END AS precipitation
FROM events""", ["event_id"], ["precipitation"])


@register("precip_from_observation", OBS_SQL)
def q_obs(spark, sf_dir):
    return RD.precip_from_observation(observation_docs(spark, sf_dir), "obs", unit="m").drop("obs")


# --- S7: METAR text rendered from events ----------------------------------------------
_WX_BY_TYPE = {"click": "-RA", "view": "RA BKN020", "purchase": "SHRA", "error": "+TSRA", "signup": "FEW030"}


def metar_reports(spark, sf_dir):
    """One METAR report per event: station id, day-time group, a weather
    group chosen by event type and a remark with an amount chosen by value."""
    ev = V.table(spark, sf_dir, "events")
    wx = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _WX_BY_TYPE.items()], F.lit(""))
    hund = F.lpad((F.floor(F.col("value")) % 10000).cast("string"), 4, "0")
    rmk = (F.when(F.col("value") > 100, F.concat(F.lit("AO2 P"), hund))
           .when(F.col("value") > 50, F.concat(F.lit("AO2 6"), hund))
           .otherwise(F.lit("AO2")))
    raw = F.concat_ws(" ", F.lit("METAR"),
                      F.concat(F.lit("K"), F.upper(F.substring(F.md5(F.col("user_id").cast("string")), 1, 3))),
                      F.concat(F.date_format("ts", "ddHHmm"), F.lit("Z")), F.lit("18005KT"), wx,
                      F.lit("RMK"), rmk)
    return ev.select("event_id", "event_type", "ts", F.col("user_id").alias("station_key"), raw.alias("raw"))


METAR_SQL = rounded("""
SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase', 'error') THEN
    CASE WHEN value > 100 THEN (floor(value) % 10000) * 0.254 WHEN value > 50 THEN (floor(value) % 10000) * 0.254 / 6
         ELSE 0.5 END ELSE 0.0 END AS precipitation
FROM events""", ["event_id"], ["precipitation"])


@register("precip_from_metar", METAR_SQL)
def q_metar(spark, sf_dir):
    return RD.precip_from_metar(metar_reports(spark, sf_dir)).select("event_id", "precipitation")


# --- S8: observed override of the current model precipitation --------------------------
OVERRIDE_SQL = rounded(f"""
WITH cur AS (SELECT series_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, arg_max(v_sum, ts) / 1000 AS precipitation
             FROM {V.EV_HOURLY_SQL} AS h GROUP BY 1, 2),
obs AS (SELECT event_type AS series_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day,
          arg_max(CASE WHEN event_type IN ('click', 'view', 'purchase', 'error') THEN
            CASE WHEN value > 100 THEN (floor(value) % 10000) * 0.254 WHEN value > 50 THEN (floor(value) % 10000) * 0.254 / 6
                 ELSE 0.5 END ELSE 0.0 END, (ts, event_id)) AS observed
        FROM events GROUP BY 1, 2)
SELECT cur.series_id, cur.day, CASE WHEN obs.observed IS NOT NULL THEN obs.observed ELSE coalesce(cur.precipitation, 0) END AS precipitation,
  CASE WHEN obs.observed IS NOT NULL THEN 'station' ELSE 'model' END AS precipitation_source,
  coalesce(CASE WHEN obs.observed IS NOT NULL THEN obs.observed ELSE coalesce(cur.precipitation, 0) END > 0.1, false) AS raining
FROM cur LEFT JOIN obs ON cur.series_id = obs.series_id AND cur.day = obs.day""",
    ["series_id", "day", "precipitation_source", "raining"], ["precipitation"])


@register("observed_override", OVERRIDE_SQL)
def q_override(spark, sf_dir):
    """Per (series, day): the day's last model precipitation, replaced by the
    latest station report of the day when one exists."""
    docs = hourly_docs(spark, sf_dir)
    cur = RD.current_conditions(
        docs.select("series_id", "day", F.from_json("doc", RD.FORECAST_SCHEMA)["current"].alias("current")),
        ["series_id", "day"]).select("series_id", "day", "precipitation")
    m = RD.precip_from_metar(metar_reports(spark, sf_dir))
    obs = m.groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").cast("timestamp_ntz").alias("day")).agg(
        F.max_by("precipitation", F.struct("ts", "event_id")).alias("observed"))
    return RD.observed_override(cur, obs, ["series_id", "day"])

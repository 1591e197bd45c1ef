"""Driver queries for projections, filters and scalar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirro.functions import weather as WF
from cirro.operators import select as SE
from cirro.plans import views as V
from cirro.plans.layout import run_windows
from cirro.plans.registry import register, rounded

W_SQL = V.EV_WEATHER_SQL
WH = "PARTITION BY series_id ORDER BY ts"
NOW = "2024-01-30 12:00:00"      # fixed "now" of the look-back queries


def wx(spark, sf_dir):
    return V.ev_weather(spark, sf_dir)


LOOKBACK_SQL = rounded(f"""SELECT series_id, ts, pressure FROM {W_SQL} AS w
WHERE ts >= date_trunc('day', TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AND ts <= TIMESTAMP '{NOW}'""",
    ["series_id", "ts"], ["pressure"])


@register("lookback", LOOKBACK_SQL)
def q_lookback(spark, sf_dir):
    return SE.lookback(wx(spark, sf_dir), NOW, 7).select("series_id", "ts", "pressure")


FLAG_SQL = f"SELECT series_id, ts, coalesce(precipitation > 0.1, false) AS raining FROM {W_SQL} AS w"


@register("event_flag", FLAG_SQL)
def q_flag(spark, sf_dir):
    w = wx(spark, sf_dir)
    return w.select("series_id", "ts", WF.event_flag("precipitation", 0.1).alias("raining"))


RANGE_SQL = rounded(f"""SELECT w.series_id, w.ts, w.pressure FROM {W_SQL} AS w
JOIN (SELECT series_id, max(ts) AS last FROM {W_SQL} AS x GROUP BY 1) AS l ON w.series_id = l.series_id
WHERE w.ts > l.last - INTERVAL 3 DAY""", ["series_id", "ts"], ["pressure"])


@register("time_range", RANGE_SQL)
def q_range(spark, sf_dir):
    return SE.time_range(wx(spark, sf_dir), ["series_id"], 3).select("series_id", "ts", "pressure")


_SAN_IN = f"""(SELECT series_id, ts, CASE WHEN pressure > 1250 THEN 'Infinity'::DOUBLE WHEN pressure < 951 THEN 'NaN'::DOUBLE
   WHEN pressure < 952 THEN '-Infinity'::DOUBLE ELSE pressure END AS p_raw FROM {W_SQL} AS w)"""
SANITIZE_SQL = rounded(f"""SELECT series_id, ts,
  CASE WHEN isnan(p_raw) OR isinf(p_raw) THEN 0.0 ELSE p_raw END AS p_zero,
  CASE WHEN isnan(p_raw) OR isinf(p_raw) THEN NULL ELSE p_raw END AS p_null FROM {_SAN_IN} AS s""",
    ["series_id", "ts"], ["p_zero", "p_null"])


@register("sanitize", SANITIZE_SQL)
def q_sanitize(spark, sf_dir):
    w = wx(spark, sf_dir)
    raw = (F.when(F.col("pressure") > 1250, F.lit(float("inf")))
           .when(F.col("pressure") < 951, F.lit(float("nan")))
           .when(F.col("pressure") < 952, F.lit(float("-inf"))).otherwise(F.col("pressure")))
    w = w.select("series_id", "ts", raw.alias("p_raw"))
    return w.select("series_id", "ts", WF.sanitize("p_raw", 0.0).alias("p_zero"),
                    WF.sanitize("p_raw").alias("p_null"))


_CLEAN = "CASE WHEN isnan({0}) OR isinf({0}) THEN NULL ELSE {0} END"
NESTED_SQL = rounded(f"""SELECT series_id, ts, {_CLEAN.format('p_raw')} AS top, {_CLEAN.format('p_raw')} AS inner_value, {_CLEAN.format('p_raw + 1')} AS second,
  {_CLEAN.format('p_raw')} AS by_name, {_CLEAN.format('p_raw - 1')} AS deep FROM {_SAN_IN} AS s""",
    ["series_id", "ts"], ["top", "inner_value", "second", "by_name", "deep"])


@register("sanitize_nested", NESTED_SQL)
def q_sanitize_nested(spark, sf_dir):
    """F4 in a struct, an array, a map and an array of structs."""
    raw = (F.when(F.col("pressure") > 1250, F.lit(float("inf")))
           .when(F.col("pressure") < 951, F.lit(float("nan")))
           .when(F.col("pressure") < 952, F.lit(float("-inf"))).otherwise(F.col("pressure")))
    w = wx(spark, sf_dir).select("series_id", "ts", raw.alias("p"))
    nested = w.select("series_id", "ts", F.col("p").alias("top"), F.struct(F.col("p").alias("v"), F.lit("x").alias("note")).alias("s"),
                      F.array(F.lit(0.0), F.col("p") + 1).alias("a"), F.create_map(F.lit("p"), F.col("p")).alias("m"),
                      F.array(F.struct((F.col("p") - 1).alias("d"))).alias("n"))
    c = WF.sanitize_all(nested)
    return c.select("series_id", "ts", "top", F.col("s.v").alias("inner_value"), F.col("a")[1].alias("second"),
                    F.col("m")["p"].alias("by_name"), F.col("n")[0]["d"].alias("deep"))


# --- F5 / F6 -----------------------------------------------------------------------------
NUMERIC_SQL = rounded(f"SELECT temperature, humidity, pressure, precipitation, wind_speed, cloud_cover, wind_direction FROM {W_SQL} AS w", [], V.WEATHER_COLS)


@register("numeric_columns", NUMERIC_SQL)
def q_numeric(spark, sf_dir):
    """the numeric columns of the hourly table."""
    w = wx(spark, sf_dir)
    return w.select(*SE.numeric_columns(w))


FEATURES_SQL = rounded(f"SELECT series_id, ts, temperature, humidity, pressure, wind_speed, cloud_cover, wind_direction, pressure / 2000 AS volatile_prob FROM {W_SQL} AS w",
                       ["series_id", "ts"], ["temperature", "humidity", "pressure", "wind_speed", "cloud_cover", "wind_direction", "volatile_prob"])


@register("feature_columns", FEATURES_SQL)
def q_feature_columns(spark, sf_dir):
    """without the target, precipitation and regime columns; volatile_prob stays."""
    w = wx(spark, sf_dir).withColumn("label", (F.col("precipitation") > 0.1).cast("int")).withColumn("regime_0", F.lit(0.5)).withColumn(
        "volatile_prob", F.col("pressure") / 2000)
    return w.select("series_id", "ts", *SE.feature_columns(w, "label"))


MODEL_COLS = ["pressure", "humidity", "dewpoint", "temperature"]
ALIGN_SQL = rounded(f"SELECT series_id, ts, pressure, humidity, 0.0 AS dewpoint, temperature FROM {W_SQL} AS w",
                    ["series_id", "ts"], MODEL_COLS)


@register("align_features", ALIGN_SQL)
def q_align(spark, sf_dir):
    return SE.align_features(wx(spark, sf_dir), MODEL_COLS, keep=["series_id", "ts"])


INTER_SQL = rounded(f"""SELECT series_id, ts, temperature * humidity / 100 AS temp_humidity,
  pressure * humidity / 1000 AS pressure_humidity, coalesce(temperature * pressure / 100, 0) AS temp_pressure,
  coalesce(wind_speed * humidity / 100, 0) AS wind_humidity FROM {W_SQL} AS w""", ["series_id", "ts"],
    ["temp_humidity", "pressure_humidity", "temp_pressure", "wind_humidity"])


@register("interactions", INTER_SQL)
def q_inter(spark, sf_dir):
    w = wx(spark, sf_dir)
    feats = dict(WF.interactions())
    an = dict(WF.interactions(analytics=True))
    return w.select("series_id", "ts", feats["temp_humidity"].alias("temp_humidity"),
                    feats["pressure_humidity"].alias("pressure_humidity"),
                    an["temp_pressure"].alias("temp_pressure"), an["wind_humidity"].alias("wind_humidity"))


ISO_SQL = f"""SELECT event_type AS series_id, event_id,
  CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts_iso
FROM events"""


@register("iso_format", ISO_SQL)
def q_iso(spark, sf_dir):
    ev = V.ev_raw(spark, sf_dir)
    return ev.select("series_id", "event_id", WF.iso_format("ts").alias("ts_iso"))


HORIZON_SQL = f"""SELECT o_orderkey, CAST(least(168, greatest(1, trunc((epoch(strptime(strftime(o_orderdate, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M'))
   - epoch(TIMESTAMP '1995-06-15 08:30:00')) / 3600))) AS BIGINT) AS horizon_h FROM orders"""


@register("horizon_hours", HORIZON_SQL)
def q_horizon(spark, sf_dir):
    """Order dates rendered as the reference's 'dd/mm/yyyy hh:mm' text, parsed,
    and turned into forecast horizons from a fixed 'now'."""
    o = V.table(spark, sf_dir, "orders")
    text = F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")
    target = WF.parse_day_first(text)
    return o.select("o_orderkey", WF.horizon_hours(target, F.lit("1995-06-15 08:30:00").cast("timestamp_ntz"))
                    .alias("horizon_h"))


THERMO_SQL = rounded(f"""SELECT series_id, ts, temperature * exp(0.0002 * humidity * pressure / 1000) AS theta_e_proxy,
  humidity - 100 AS sat_deficit, temperature - 10 * ln(pressure / 1000) AS lifted_index_proxy FROM {W_SQL} AS w""",
    ["series_id", "ts"], ["theta_e_proxy", "sat_deficit", "lifted_index_proxy"])


@register("thermo_proxies", THERMO_SQL)
def q_thermo(spark, sf_dir):
    w = wx(spark, sf_dir)
    return w.select("series_id", "ts", *[e.alias(n) for n, e in WF.thermo_proxies()])


STORM_SQL = rounded(f"""SELECT series_id, ts,
  -greatest(-10.0, least(0.0, pressure - lag(pressure, 3) OVER ({WH}))) * humidity / 100 AS storm_risk,
  CASE WHEN abs(pressure - lag(pressure, 3) OVER ({WH})) > 2 AND abs(temperature - lag(temperature, 3) OVER ({WH})) > 2
       THEN 1.0 ELSE 0.0 END AS frontal_indicator FROM {W_SQL} AS w""", ["series_id", "ts"],
    ["storm_risk", "frontal_indicator"])


@register("storm_risk", STORM_SQL)
def q_storm(spark, sf_dir):
    w = wx(spark, sf_dir).select("series_id", "ts", "pressure", "temperature", "humidity")

    def build(sw):
        dp3 = F.col("pressure") - sw.lag("pressure", 3)
        dt3 = F.col("temperature") - sw.lag("temperature", 3)
        return [("storm_risk", WF.storm_risk(dp3)), ("frontal_indicator", WF.frontal_indicator(dp3, dt3))]
    return run_windows(w, V.HOURLY_SPEC, build, lookback=3).drop("pressure", "temperature", "humidity")


CAL_SQL = rounded(f"""SELECT series_id, ts, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofyear(ts) AS INTEGER) AS day_of_year,
  CAST(month(ts) AS INTEGER) AS month,
  sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
  sin(2 * pi() * dayofyear(ts) / 365.25) AS doy_sin, cos(2 * pi() * dayofyear(ts) / 365.25) AS doy_cos,
  sin(2 * pi() * ((isodow(ts) - 1) * 24 + hour(ts)) / 168) AS week_sin,
  cos(2 * pi() * ((isodow(ts) - 1) * 24 + hour(ts)) / 168) AS week_cos,
  sin(2 * pi() * hour(ts) / 168) AS week_sin_compat FROM {W_SQL} AS w""",
    ["series_id", "ts", "hour", "day_of_year", "month"],
    ["hour_sin", "hour_cos", "doy_sin", "doy_cos", "week_sin", "week_cos", "week_sin_compat"])


@register("calendar_cyclic", CAL_SQL)
def q_calendar(spark, sf_dir):
    w = wx(spark, sf_dir)
    compat = dict(WF.cyclic_time(compat_week=True))
    return w.select("series_id", "ts", *[e.alias(n) for n, e in WF.calendar_parts()],
                    *[e.alias(n) for n, e in WF.cyclic_time()],
                    compat["week_sin"].alias("week_sin_compat"))

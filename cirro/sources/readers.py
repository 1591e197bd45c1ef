"""Readers for the landed inputs.

Landing files is the input boundary: forecast JSON documents, station
lists (CSV or JSON), observation JSON and METAR reports.  Every reader
is ``spark.read`` with an explicit schema (no inference) followed by
DataFrame expressions, so the same code parses a file or a column of
JSON text (``from_json``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

D = T.DoubleType()
_ARR = T.ArrayType(D)
HOURLY_FIELDS = ["temperature_2m", "relative_humidity_2m", "surface_pressure", "pressure_msl",
                 "precipitation", "cloud_cover", "wind_speed_10m", "wind_direction_10m", "dewpoint_2m"]
CURRENT_FIELDS = ["temperature_2m", "relative_humidity_2m", "surface_pressure", "cloud_cover",
                  "wind_speed_10m", "wind_direction_10m", "precipitation"]
HOURLY_STRUCT = T.StructType([T.StructField("time", T.ArrayType(T.StringType()))]
                             + [T.StructField(f, _ARR) for f in HOURLY_FIELDS])
CURRENT_STRUCT = T.StructType([T.StructField(f, D) for f in CURRENT_FIELDS])
FORECAST_SCHEMA = T.StructType([
    T.StructField("location", T.StringType()),
    T.StructField("hourly", HOURLY_STRUCT),
    T.StructField("current", CURRENT_STRUCT),
])
OBS_SCHEMA = T.StructType([T.StructField("properties", T.StructType([
    T.StructField("precipitationLastHour", T.StructType([T.StructField("value", D)])),
    T.StructField("precipitationLast3Hours", T.StructType([T.StructField("value", D)])),
    T.StructField("precipitationLast6Hours", T.StructType([T.StructField("value", D)])),
    T.StructField("rawMessage", T.StringType()),
    T.StructField("textDescription", T.StringType()),
]))])

# Fixed values of the reference's input handling.
DEFAULT_PRESSURE = 1013.0
ID_ALIASES = ["ident", "icao", "gps_code"]
LAT_ALIASES = ["latitude_deg", "lat", "latitude"]
LON_ALIASES = ["longitude_deg", "lon", "longitude"]
NAME_ALIASES = ["name", "airport_name"]
TYPE_ALIASES = ["type", "airport_type"]
RAIN_NO_AMOUNT_MM = 0.5
HUNDREDTH_INCH_MM = 0.254
RAINING_THRESHOLD_MM = 0.1


# --- S1 / S2 ---------------------------------------------------------------------
def explode_hourly(docs: DataFrame, keys: Sequence[str] = ("location",), hourly: str = "hourly") -> DataFrame:
    """Parallel arrays under ``hourly`` -> one row per hour, with the
    column fallbacks of S2: pressure = surface_pressure, else pressure_msl,
    else 1013 (whole-array choice, as the reference picks a key); cloud
    cover and wind default 0; dewpoint only if present."""
    h = F.col(hourly)
    n = F.size(h["time"])
    zeros = F.array_repeat(F.lit(0.0), n)
    const_p = F.array_repeat(F.lit(DEFAULT_PRESSURE), n)
    # arrays_zip yields NULL if any input is NULL: absent optional arrays
    # become arrays of NULLs of the right length.
    nulls = F.array_repeat(F.lit(None).cast("double"), n)
    zipped = F.arrays_zip(
        h["time"].alias("time"),
        F.coalesce(h["temperature_2m"], nulls).alias("temperature"),
        F.coalesce(h["relative_humidity_2m"], nulls).alias("humidity"),
        F.coalesce(h["surface_pressure"], h["pressure_msl"], const_p).alias("pressure"),
        F.coalesce(h["precipitation"], nulls).alias("precipitation"),
        F.coalesce(h["cloud_cover"], zeros).alias("cloud_cover"),
        F.coalesce(h["wind_speed_10m"], zeros).alias("wind_speed"),
        F.coalesce(h["wind_direction_10m"], zeros).alias("wind_direction"),
        F.coalesce(h["dewpoint_2m"], nulls).alias("dewpoint"),
    )
    rows = docs.select(*keys, F.inline(zipped))
    return rows.select(*keys, F.to_timestamp_ntz("time").alias("ts"), "temperature", "humidity",
                       "pressure", "precipitation", "cloud_cover", "wind_speed", "wind_direction",
                       "dewpoint")


def read_hourly_json(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(FORECAST_SCHEMA).json(path)
    return explode_hourly(docs)


def parse_hourly_text(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Same as ``read_hourly_json`` for JSON held in a string column."""
    docs = df.select(*keys, F.from_json(text, FORECAST_SCHEMA).alias("_doc"))
    return explode_hourly(docs.select(*keys, F.col("_doc.hourly").alias("hourly")), keys)


# --- S3 ------------------------------------------------------------------------
def current_conditions(docs: DataFrame, keys: Sequence[str] = ("location",)) -> DataFrame:
    """``current`` struct -> one row per document, missing values 0."""
    c = F.col("current")
    return docs.select(*keys, *[F.coalesce(c[f], F.lit(0.0)).alias(f) for f in CURRENT_FIELDS])


def read_current_json(spark: SparkSession, path: str) -> DataFrame:
    return current_conditions(spark.read.schema(FORECAST_SCHEMA).json(path))


# --- S4 / S5 -----------------------------------------------------------------------
def _first_present(cols: Sequence[str], aliases: Sequence[str]):
    return next((a for a in aliases if a in cols), None)


def normalize_stations(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Pick id/lat/lon/name/type from the first alias present; ``keep``
    columns pass through."""
    cols = df.columns
    idc = _first_present(cols, ID_ALIASES)
    lat = _first_present(cols, LAT_ALIASES)
    lon = _first_present(cols, LON_ALIASES)
    name = _first_present(cols, NAME_ALIASES)
    typ = _first_present(cols, TYPE_ALIASES)
    if idc is None or lat is None or lon is None:
        raise ValueError(f"station list lacks id/lat/lon columns: {cols}")
    return df.select(F.col(idc).cast("string").alias("raw_id"),
                     F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"),
                     (F.col(name).cast("string") if name else F.lit(None).cast("string")).alias("name"),
                     (F.col(typ).cast("string") if typ else F.lit(None).cast("string")).alias("type"),
                     *keep)


def read_stations(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
    elif fmt == "json":
        raw = spark.read.json(path)
    else:
        raise ValueError(fmt)
    return normalize_stations(raw)


def valid_stations(stations: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Keep ``upper(trim(id))`` of length 4 with both coordinates."""
    sid = F.upper(F.trim(F.col("raw_id")))
    return (stations.withColumn("station_id", sid)
            .filter((F.length("station_id") == 4) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
            .select("station_id", "name", "lat", "lon", "type", *keep))


# --- rain tokens (shared by S6 and S7) ----------------------------------------------
# A present-weather group containing rain or drizzle, matched as a whole token
# (intensity/proximity/recent prefix, descriptor, phenomena): -RA, +TSRA, SHRA,
# RERA, DZ, RASN ...  Station ids and time groups never match.
_WX = r"(\+|-|VC|RE)?(TS|SH|FZ)?(RA|DZ|SN|PL|GR|GS)*(RA|DZ)(RA|DZ|SN|PL|GR|GS)*"
RAIN_TOKEN = rf"(^|\s){_WX}(?=\s|$)"


def metar_parts(raw: Column) -> tuple[Column, Column]:
    """(weather part after the day-time group, remarks after ' RMK ')."""
    parts = F.split(raw, r"\sRMK\s", 2)
    body = F.element_at(parts, 1)
    rmk = F.when(F.size(parts) > 1, F.element_at(parts, 2))
    after_time = F.regexp_extract(body, r"\b\d{6}Z\b(.*)$", 1)
    wx = F.when(body.rlike(r"\b\d{6}Z\b"), after_time).otherwise(
        F.regexp_replace(body, r"^\s*(METAR\s+|SPECI\s+)?\S+", ""))
    return wx, rmk


def has_rain_token(text: Column) -> Column:
    return F.coalesce(text.rlike(RAIN_TOKEN), F.lit(False))


# --- S6 ------------------------------------------------------------------------------
def precip_from_observation(obs: DataFrame, json_col: str | None = None, unit: str = "m") -> DataFrame:
    """Observation precipitation per hour in mm: last hour, else 3 h / 3,
    else 6 h / 6, else 0; a 0 with a rain report (weather token in the
    raw message or 'rain' in the description) becomes 0.5.

    ``unit`` is the unit of the values ('m' in the reference's service,
    Q10).  ``json_col`` names a JSON text column; otherwise the frame
    already has the ``properties`` struct."""
    scale = {"m": 1000.0, "mm": 1.0, "cm": 10.0}[unit]
    df = obs.withColumn("_o", F.from_json(json_col, OBS_SCHEMA)) if json_col else obs.withColumn(
        "_o", F.struct(F.col("properties").alias("properties")))
    pr = F.col("_o.properties")
    amount = F.coalesce(pr["precipitationLastHour"]["value"] * scale,
                        pr["precipitationLast3Hours"]["value"] * scale / 3,
                        pr["precipitationLast6Hours"]["value"] * scale / 6,
                        F.lit(0.0))
    raining = has_rain_token(metar_parts(F.coalesce(pr["rawMessage"], F.lit("")))[0]) | \
        F.lower(F.coalesce(pr["textDescription"], F.lit(""))).contains("rain")
    val = F.when((amount == 0) & raining, F.lit(RAIN_NO_AMOUNT_MM)).otherwise(amount)
    return df.withColumn("precipitation", val).drop("_o")


# --- S7 ------------------------------------------------------------------------------
def precip_from_metar(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """METAR precipitation in mm (per hour), Q9 rules: rain tokens are
    whole weather groups after the time group; amounts only from the
    remarks: P#### (hundredths of an inch in the last hour) x 0.254, else
    6#### (6-hour amount) x 0.254 / 6; rain without amount 0.5; no rain 0."""
    wx, rmk = metar_parts(F.col(raw))
    p_amt = F.regexp_extract(F.coalesce(rmk, F.lit("")), r"(^|\s)P(\d{4})(?=\s|$)", 2)
    six = F.regexp_extract(F.coalesce(rmk, F.lit("")), r"(^|\s)6(\d{4})(?=\s|$)", 2)
    amount = (F.when(p_amt != "", p_amt.cast("double") * HUNDREDTH_INCH_MM)
              .when(six != "", six.cast("double") * HUNDREDTH_INCH_MM / 6)
              .otherwise(F.lit(RAIN_NO_AMOUNT_MM)))
    return reports.withColumn("precipitation", F.when(has_rain_token(wx), amount).otherwise(F.lit(0.0)))


# --- S8 ------------------------------------------------------------------------------
def observed_override(current: DataFrame, observed: DataFrame, keys: Sequence[str],
                      model_col: str = "precipitation", obs_col: str = "observed") -> DataFrame:
    """Station precipitation replaces the model's when present; records the
    source and the raining flag (> 0.1 mm)."""
    j = current.join(observed.select(*keys, F.col(obs_col).alias("_obs")), list(keys), "left")
    has = F.col("_obs").isNotNull()
    p = F.when(has, F.col("_obs")).otherwise(F.coalesce(F.col(model_col), F.lit(0.0)))
    return (j.withColumn(model_col, p)
            .withColumn("precipitation_source", F.when(has, "station").otherwise("model"))
            .withColumn("raining", F.coalesce(F.col(model_col) > RAINING_THRESHOLD_MM, F.lit(False)))
            .drop("_obs"))


# --- S9 ------------------------------------------------------------------------------
# The reference's named locations (name, latitude, longitude).
LOCATIONS = [
    ("windhoek", "Windhoek, Namibia", -22.56, 17.08),
    ("tsumeb", "Tsumeb, Namibia", -19.2484, 17.7135),
    ("walvis_bay", "Walvis Bay, Namibia", -22.9575, 14.5053),
    ("keetmanshoop", "Keetmanshoop, Namibia", -26.5833, 18.1333),
    ("grootfontein", "Grootfontein, Namibia", -19.5667, 18.1167),
]


def named_points(points: DataFrame, lat: str = "lat", lon: str = "lon", name: str = "name") -> DataFrame:
    """Custom points as locations: ``location_id`` 'custom'; a point without a name is called 'Custom (lat, lon)'."""
    given = F.col(name) if name in points.columns else F.lit(None).cast("string")
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    return points.select(F.lit("custom").alias("location_id"), F.coalesce(given, F.format_string("Custom (%.4f, %.4f)", la, lo)).alias("name"),
                         la.alias("lat"), lo.alias("lon"))


def location_dim(spark: SparkSession, custom: Sequence[tuple] | DataFrame = ()) -> DataFrame:
    """The named locations plus custom points: (lat, lon[, name]) tuples, or a
    table of any size with lat, lon and maybe name."""
    named = spark.createDataFrame([(i, n, float(a), float(b)) for i, n, a, b in LOCATIONS], "location_id string, name string, lat double, lon double")
    if not isinstance(custom, DataFrame):
        custom = spark.createDataFrame([(float(c[0]), float(c[1]), c[2] if len(c) > 2 else None) for c in custom], "lat double, lon double, name string")
    return named.unionByName(named_points(custom))

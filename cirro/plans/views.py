"""

The driver's tables are not weather data; these views give them the
shape the operators expect: ``series_id``, a timestamp ``ts`` and value
columns.  Each view is plain DataFrame code, so filters and column
pruning reach the Parquet scan.

* ``ev_raw``      events, series = event_type, order = (ts, event_id),
                  x = value, k = JSON ``props.k``
* ``ev_hourly``   events rolled up per (event_type, hour): v_avg, v_sum,
                  n, k_avg -- the hourly observation frame
* ``orders_daily`` orders per (o_orderpriority, day): amount, n
* ``scored``      ev_raw with three deterministic scores (long table
                  ``model, p``) and the future label of W19
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirro.plans.layout import run_windows
from cirro.plans.series import SeriesSpec

RAW_SPEC = SeriesSpec(keys=("series_id",), order="ts", tiebreak=("event_id",))
HOURLY_SPEC = SeriesSpec(keys=("series_id",), order="ts")
DAILY_SPEC = SeriesSpec(keys=("series_id",), order="ts")

# Fixed parameters of the stand-in "event" (the rain analogue) on events.
EVENT_THR_RAW = 100.0      # x > 100 counts as an event row
LABEL_H_RAW = 6            # label: sum of next 6 values > LABEL_THR_RAW
LABEL_THR_RAW = 300.0
SCORE_SCALE = 50.0         # p = m / (m + 50) for a non-negative signal m


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_floor(c) -> F.Column:
    """Wall-clock hour of a TIMESTAMP_NTZ, independent of the session zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c),
                                F.lit(0), F.lit(0))


def day_floor(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.lit(0),
                                F.lit(0), F.lit(0))


def ev_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("series_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "event_id",
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def ev_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return (ev.groupBy(F.col("event_type").alias("series_id"), hour_floor("ts").alias("ts"))
            .agg(F.avg("value").alias("v_avg"), F.sum("value").alias("v_sum"),
                 F.count(F.lit(1)).alias("n"), F.avg(k).alias("k_avg")))


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("series_id"),
                      day_floor("o_orderdate").alias("ts"))
            .agg(F.sum("o_totalprice").alias("amount"), F.count(F.lit(1)).alias("n")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (series_id, ts, event_id, model, p, label).

    Scores are deterministic functions of the data (current value, mean
    of the last 6 and of the last 24 rows) mapped to [0, 1) and floored to
    3 digits so that ties occur; the label is W19 with H=6.  It is the
    stand-in for model output feeding the metric operators.
    """
    from cirro.operators.windows import future_label_col

    raw = ev_raw(spark, sf_dir)

    def build(sw):
        m6 = F.avg("x").over(sw.trailing(6))
        m24 = F.avg("x").over(sw.trailing(24))
        return [("s_now", F.col("x")), ("s_mean6", m6), ("s_mean24", m24),
                ("label", future_label_col(sw, "x", LABEL_H_RAW, LABEL_THR_RAW))]
    w = run_windows(raw, RAW_SPEC, build, lookback=23, lookahead=LABEL_H_RAW)
    w = w.filter(F.col("label").isNotNull())
    models = F.array(
        F.struct(F.lit("m_now").alias("model"), F.col("s_now").alias("s")),
        F.struct(F.lit("m_mean6").alias("model"), F.col("s_mean6").alias("s")),
        F.struct(F.lit("m_mean24").alias("model"), F.col("s_mean24").alias("s")),
    )
    long = w.select("series_id", "ts", "event_id", "label", F.inline(models))
    return long.select("series_id", "ts", "event_id", "model",
                       (F.floor(F.col("s") / (F.col("s") + SCORE_SCALE) * 1000) / 1000).alias("p"),
                       "label")


SCORED_SQL = f"""
  (WITH r AS (SELECT event_type AS series_id, ts, event_id, value AS x FROM events),
   w AS (SELECT series_id, ts, event_id, x AS s_now,
           avg(x) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s_mean6,
           avg(x) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS s_mean24,
           CASE WHEN count(*) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND {LABEL_H_RAW} FOLLOWING) >= {LABEL_H_RAW}
                THEN CASE WHEN coalesce(sum(x) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND {LABEL_H_RAW} FOLLOWING), 0) > {LABEL_THR_RAW} THEN 1 ELSE 0 END END AS label
         FROM r),
   l AS (SELECT series_id, ts, event_id, label, 'm_now' AS model, s_now AS s FROM w WHERE label IS NOT NULL
         UNION ALL SELECT series_id, ts, event_id, label, 'm_mean6', s_mean6 FROM w WHERE label IS NOT NULL
         UNION ALL SELECT series_id, ts, event_id, label, 'm_mean24', s_mean24 FROM w WHERE label IS NOT NULL)
   SELECT series_id, ts, event_id, model, floor(s / (s + {SCORE_SCALE}) * 1000) / 1000 AS p, label FROM l)
"""

EV_RAW_SQL = """(SELECT event_type AS series_id, ts, event_id, value AS x,
   CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""

EV_HOURLY_SQL = """(SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
   avg(value) AS v_avg, sum(value) AS v_sum, count(*) AS n,
   avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k_avg
   FROM events GROUP BY 1, 2)"""

ORDERS_DAILY_SQL = """(SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts,
   sum(o_totalprice) AS amount, count(*) AS n FROM orders GROUP BY 1, 2)"""


def ev_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly view under weather names (linear renderings of its
    columns): temperature, humidity, pressure, precipitation, wind, cloud."""
    h = ev_hourly(spark, sf_dir)
    return h.select(
        "series_id", "ts",
        (F.col("k_avg") / 2).alias("temperature"),
        F.least(F.lit(100.0), F.col("n") * 10.0).alias("humidity"),
        (F.col("v_avg") + 950).alias("pressure"),
        (F.col("v_avg") / 100).alias("precipitation"),
        (F.col("v_avg") / 10).alias("wind_speed"),
        F.least(F.lit(100.0), F.col("k_avg")).alias("cloud_cover"),
        ((F.col("k_avg") * 3.6) % 360).alias("wind_direction"))


EV_WEATHER_SQL = f"""(SELECT series_id, ts, k_avg / 2 AS temperature, least(100.0, n * 10.0) AS humidity,
   v_avg + 950 AS pressure, v_avg / 100 AS precipitation, v_avg / 10 AS wind_speed,
   least(100.0, k_avg) AS cloud_cover, (k_avg * 3.6) % 360 AS wind_direction FROM {EV_HOURLY_SQL} AS h)"""
WEATHER_COLS = ["temperature", "humidity", "pressure", "precipitation", "wind_speed", "cloud_cover",
                "wind_direction"]

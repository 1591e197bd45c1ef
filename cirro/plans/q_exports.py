"""Driver queries for sinks, exports (S10-S14) and the streaming ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirro.operators import aggregates as A
from cirro.operators import windows as W
from cirro.plans import views as V
from cirro.plans.q_aggregates import GRID_COLS
from cirro.plans.q_grades import GRADES_SQL
from cirro.plans.registry import register, rounded
from cirro.plans.series import POS
from cirro.sources import sinks as SK

HOURLY_ROUNDTRIP_SQL = rounded(f"SELECT * FROM {V.EV_HOURLY_SQL} AS h", ["series_id", "ts", "n"],
                               ["v_avg", "v_sum", "k_avg"])


@register("write_series", HOURLY_ROUNDTRIP_SQL)
def q_write_series(spark, sf_dir):
    """The hourly view written per series and read back."""
    path = SK.scratch_path(spark, "hourly")
    SK.write_series(V.ev_hourly(spark, sf_dir), path)
    return spark.read.parquet(path).select("series_id", "ts", "v_avg", "v_sum", "n", "k_avg")


@register("stream_hourly_rollup", HOURLY_ROUNDTRIP_SQL)
def q_stream(spark, sf_dir):
    """The hourly view built by a Structured Streaming job over the events
    files (partials per micro-batch, merged on read)."""
    from cirro.streaming.hourly import read_hourly_rollup, start_hourly_rollup
    sink, ck = SK.scratch_path(spark, "stream-sink"), SK.scratch_path(spark, "stream-ckpt")
    q = start_hourly_rollup(spark, sf_dir, sink, ck, glob="events.parquet")
    q.awaitTermination()
    return read_hourly_rollup(spark, sink)


APPEND_SQL = f"""SELECT g.*, '6h' AS timeframe
FROM (SELECT * FROM ({GRADES_SQL}) AS a QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, event_id DESC) = 1) AS g, (VALUES (1), (2)) AS twice(n)"""


@register("append_forecasts", APPEND_SQL)
def q_append_forecasts(spark, sf_dir):
    """Latest graded forecast per series appended twice to one table (its reasons are text that is not compared)."""
    from cirro.plans.q_grades import graded
    g = graded(spark, sf_dir)
    last = g.groupBy("series_id").agg(F.max(F.struct("ts", "event_id")).alias("_k"))
    rec = (g.join(last, "series_id").filter(F.struct("ts", "event_id") == F.col("_k")).drop("_k")
           .withColumn("timeframe", F.lit("6h")))
    path = SK.scratch_path(spark, "forecasts")
    SK.append_forecasts(rec, path)
    SK.append_forecasts(rec, path)
    return spark.read.parquet(path).drop("reasons")


_PANEL_N = W.PANEL_WINDOWS
_STATS = ["mean", "std", "min", "max"]


def _rolling_long_sql():
    parts = []
    for n in _PANEL_N:
        for s in _STATS:
            agg = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}[s]
            parts.append(f"""SELECT series_id, 'v_avg' AS variable, '{s}_{n}h' AS statistic, rn - 1 AS idx,
  CASE WHEN len > {n} THEN coalesce({agg}(v_avg) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) END AS value
  FROM h""")
    body = " UNION ALL ".join(parts)
    return rounded(f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn,
        count(*) OVER (PARTITION BY series_id) AS len FROM {V.EV_HOURLY_SQL} AS x)
SELECT * FROM ({body}) AS u WHERE value IS NOT NULL""", ["series_id", "variable", "statistic", "idx"], ["value"])


@register("export_rolling_long", _rolling_long_sql())
def q_rolling_long(spark, sf_dir):
    h = V.ev_hourly(spark, sf_dir).select("series_id", "ts", "v_avg")
    panel = W.rolling_panel(h, V.HOURLY_SPEC, ["v_avg"], _PANEL_N, _STATS, keep_pos=True)
    cols = [f"v_avg_{s}_{n}" for n in _PANEL_N for s in _STATS]
    out = SK.export_rolling_long(panel, ["series_id"], ["ts"], cols)
    return out.withColumn("idx", F.col("idx").cast("long"))


def _matrix_sql():
    body = " UNION ALL ".join(
        f"SELECT series_id, '{a}' AS var_i, '{b}' AS var_j, coalesce(CASE WHEN isnan(corr({a}, {b})) THEN 0 ELSE corr({a}, {b}) END, 0) AS value "
        f"FROM {V.EV_HOURLY_SQL} AS h GROUP BY series_id" for a in GRID_COLS for b in GRID_COLS)
    sel = ", ".join(f"max(value) FILTER (WHERE var_j = '{b}') AS {b}" for b in GRID_COLS)
    return rounded(f"SELECT series_id, var_i, {sel} FROM ({body}) AS l GROUP BY series_id, var_i",
                   ["series_id", "var_i"], GRID_COLS)


@register("export_matrix", _matrix_sql())
def q_matrix(spark, sf_dir):
    long = A.pair_stats_long(V.ev_hourly(spark, sf_dir), ["series_id"], GRID_COLS, "corr")
    return SK.export_matrix(long, ["series_id"], GRID_COLS)


_DD_VARS = ["amount", "n"]


def _dd_sql():
    parts = []
    for v in _DD_VARS:
        peak = f"max(coalesce({v}, 0)) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        prev = f"coalesce(lag({v}) OVER (PARTITION BY series_id ORDER BY ts), 0)"
        parts.append(f"""SELECT series_id, ts, '{v}' AS variable,
  greatest(0, least(1, ({peak} - coalesce({v}, 0)) / ({peak} + 1e-10))) AS drawdown,
  CASE WHEN lag(1) OVER (PARTITION BY series_id ORDER BY ts) IS NULL THEN NULL
       ELSE (coalesce({v}, 0) - {prev}) / ({prev} + 1e-10) END AS r FROM o""")
    body = " UNION ALL ".join(parts)
    return rounded(f"""WITH o AS {V.ORDERS_DAILY_SQL}, d AS ({body}),
s AS (SELECT series_id, variable, max(drawdown) AS max_drawdown, coalesce(stddev_pop(r), 0) AS volatility,
        CASE WHEN count(*) >= 2 AND coalesce(stddev_pop(r), 0) > 1e-10 THEN (avg(r) - 0.01 / count(*)) / stddev_pop(r) ELSE 0 END AS sharpe
      FROM d GROUP BY 1, 2)
SELECT d.series_id, d.ts, d.variable, d.drawdown, s.max_drawdown, s.sharpe, s.volatility
FROM d JOIN s ON d.series_id = s.series_id AND d.variable = s.variable""",
        ["series_id", "ts", "variable"], ["drawdown", "max_drawdown", "sharpe", "volatility"])


@register("export_drawdowns", _dd_sql())
def q_drawdowns(spark, sf_dir):
    """Drawdown points with per-variable maximum, Sharpe and volatility."""
    o = V.orders_daily(spark, sf_dir).withColumn("n", F.col("n").cast("double"))
    dd = W.drawdown(o, V.DAILY_SPEC, _DD_VARS)
    long = dd.select("series_id", "ts", F.inline(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(f"{v}_drawdown").alias("drawdown")) for v in _DD_VARS])))
    stats = None
    for v in _DD_VARS:
        st = A.return_stats(o, V.DAILY_SPEC, v).select("series_id", F.lit(v).alias("variable"), "sharpe", "volatility")
        stats = st if stats is None else stats.unionByName(st)
    mx = long.groupBy("series_id", "variable").agg(F.max("drawdown").alias("max_drawdown"))
    return long.join(mx, ["series_id", "variable"]).join(stats, ["series_id", "variable"])


_ = POS

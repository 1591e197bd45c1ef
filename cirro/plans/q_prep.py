"""Driver queries for gap repair and fills (grid, W17, W18, M1, M3, A21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirro.operators import fill as FL
from cirro.operators import windows as W
from cirro.operators.quantiles import exact_quantiles
from cirro.plans import views as V
from cirro.plans.q_aggregates import GRID_COLS, GRID_SQL, grid
from cirro.plans.registry import register, rounded

WH = "PARTITION BY series_id ORDER BY ts"

GRID_Q_SQL = rounded(f"SELECT * FROM {GRID_SQL} AS g", ["series_id", "ts", "n"], ["v_avg", "v_sum", "k_avg"])


@register("hourly_grid", GRID_Q_SQL)
def q_grid(spark, sf_dir):
    return grid(spark, sf_dir)


FFILL_SQL = rounded(f"""
SELECT series_id, ts,
  last_value(v_avg IGNORE NULLS) OVER ({WH} ROWS BETWEEN 168 PRECEDING AND CURRENT ROW) AS v_avg_ffill,
  first_value(v_avg IGNORE NULLS) OVER ({WH} ROWS BETWEEN CURRENT ROW AND 168 FOLLOWING) AS v_avg_bfill
FROM {GRID_SQL} AS g""", ["series_id", "ts"], ["v_avg_ffill", "v_avg_bfill"])


@register("ffill_bfill", FFILL_SQL)
def q_ffill(spark, sf_dir):
    g = grid(spark, sf_dir).select("series_id", "ts", "v_avg")
    from cirro.plans.layout import run_windows
    return run_windows(g, V.HOURLY_SPEC, lambda sw: [
        ("v_avg_ffill", W.ffill_col(sw, "v_avg", 168)),
        ("v_avg_bfill", W.bfill_col(sw, "v_avg", 168))], lookback=168, lookahead=168).drop("v_avg")


def _interp_sql(c, limit, method, src=GRID_SQL):
    tpos = "rn" if method == "linear" else "epoch(ts)"
    return f"""
WITH p AS (SELECT series_id, ts, {c}, row_number() OVER ({WH}) AS rn FROM {src} AS g),
q AS (SELECT *, max(CASE WHEN {c} IS NOT NULL THEN rn END) OVER ({WH} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prn,
        min(CASE WHEN {c} IS NOT NULL THEN rn END) OVER ({WH} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nrn FROM p),
r AS (SELECT q.*, a.{c} AS pv, b.{c} AS nv, {tpos.replace('rn', 'q.rn').replace('epoch(ts)', 'epoch(q.ts)')} AS t_here,
        {tpos.replace('rn', 'a.rn').replace('epoch(ts)', 'epoch(a.ts)')} AS t_prev,
        {tpos.replace('rn', 'b.rn').replace('epoch(ts)', 'epoch(b.ts)')} AS t_next
      FROM q LEFT JOIN p AS a ON a.series_id = q.series_id AND a.rn = q.prn
             LEFT JOIN p AS b ON b.series_id = q.series_id AND b.rn = q.nrn)
SELECT series_id, ts, CASE WHEN {c} IS NOT NULL THEN {c}
  WHEN (prn IS NOT NULL AND rn - prn <= {limit}) OR (nrn IS NOT NULL AND nrn - rn <= {limit}) THEN
    CASE WHEN prn IS NOT NULL AND nrn IS NOT NULL THEN pv + (nv - pv) * (t_here - t_prev) / (t_next - t_prev)
         WHEN prn IS NOT NULL THEN pv ELSE nv END END AS {c}
FROM r"""


INTERP_SQL = rounded(_interp_sql("v_avg", 24, "linear"), ["series_id", "ts"], ["v_avg"])


@register("interpolate", INTERP_SQL)
def q_interp(spark, sf_dir):
    g = grid(spark, sf_dir).select("series_id", "ts", "v_avg")
    return FL.interpolate(g, V.HOURLY_SPEC, ["v_avg"], "linear", limit=24)


INTERP_TIME_SQL = rounded(_interp_sql("k_avg", 24, "time"), ["series_id", "ts"], ["k_avg"])


@register("interpolate_time", INTERP_TIME_SQL)
def q_interp_time(spark, sf_dir):
    g = grid(spark, sf_dir).select("series_id", "ts", "k_avg")
    return FL.interpolate(g, V.HOURLY_SPEC, ["k_avg"], "time", limit=24)


MEDIANS_SQL = rounded(f"""
SELECT series_id, quantile_cont(x, 0.5) AS x_median, avg(x) AS x_mean,
  quantile_cont(x, 0.25) AS x_q25, quantile_cont(x, 0.75) AS x_q75
FROM {V.EV_RAW_SQL} AS r GROUP BY series_id""", ["series_id"], ["x_median", "x_mean", "x_q25", "x_q75"])


@register("column_medians", MEDIANS_SQL)
def q_medians(spark, sf_dir):
    raw = V.ev_raw(spark, sf_dir)
    q = exact_quantiles(raw, ["series_id"], "x", [0.5, 0.25, 0.75], ["x_median", "x_q25", "x_q75"])
    m = raw.groupBy("series_id").agg(F.avg("x").alias("x_mean"))
    return q.join(m, "series_id")


CASCADE_SQL = rounded(f"""
WITH i AS ({_interp_sql('v_avg', 24, 'time')}),
m AS (SELECT series_id, quantile_cont(v_avg, 0.5) AS med FROM i GROUP BY series_id)
SELECT i.series_id, i.ts, coalesce(i.v_avg, m.med) AS v_avg FROM i JOIN m ON i.series_id = m.series_id""",
    ["series_id", "ts"], ["v_avg"])


@register("fill_cascade", CASCADE_SQL)
def q_cascade(spark, sf_dir):
    g = grid(spark, sf_dir).select("series_id", "ts", "v_avg")
    return FL.fill_cascade(g, V.HOURLY_SPEC, ["v_avg"])


_FF_B = f"""(SELECT series_id, ts, first_value(v_avg IGNORE NULLS) OVER ({WH} ROWS BETWEEN CURRENT ROW AND 168 FOLLOWING) AS v_avg
  FROM (SELECT series_id, ts, last_value(v_avg IGNORE NULLS) OVER ({WH} ROWS BETWEEN 168 PRECEDING AND CURRENT ROW) AS v_avg
        FROM {GRID_SQL} AS g) AS f)"""
FEATURE_FILL_SQL = rounded(f"""
WITH i AS ({_interp_sql('v_avg', 24, 'linear', _FF_B)}),
m AS (SELECT series_id, avg(v_avg) AS mu FROM i GROUP BY series_id)
SELECT i.series_id, i.ts, coalesce(i.v_avg, m.mu, 0) AS v_avg FROM i JOIN m ON i.series_id = m.series_id""",
    ["series_id", "ts"], ["v_avg"])


@register("feature_fill", FEATURE_FILL_SQL)
def q_feature_fill(spark, sf_dir):
    g = grid(spark, sf_dir).select("series_id", "ts", "v_avg")
    return FL.feature_fill(g, V.HOURLY_SPEC, ["v_avg"])


_ = GRID_COLS


# --- M2 ------------------------------------------------------------------------------
# Stand-in gaps: the temperature reading of an hour with a single event is
# treated as missing; pressure and humidity are the observed columns.
_KNN_IN = f"""(SELECT series_id, ts, CASE WHEN humidity > 10 THEN temperature END AS temperature, pressure, humidity
   FROM {V.EV_WEATHER_SQL} AS w)"""
KNN_SQL = rounded(f"""
WITH d AS {_KNN_IN},
h AS (SELECT * FROM d WHERE temperature IS NULL),
o AS (SELECT * FROM d WHERE temperature IS NOT NULL),
p AS (SELECT h.series_id, h.ts, o.temperature AS tv,
        sqrt((h.pressure - o.pressure) ^ 2 + (h.humidity - o.humidity) ^ 2) AS dist,
        row_number() OVER (PARTITION BY h.series_id, h.ts ORDER BY sqrt((h.pressure - o.pressure) ^ 2 + (h.humidity - o.humidity) ^ 2),
                           o.series_id || '|' || strftime(o.ts, '%Y-%m-%d %H:%M:%S')) AS rk
      FROM h JOIN o ON h.series_id = o.series_id),
e AS (SELECT series_id, ts, CASE WHEN count(*) FILTER (WHERE dist = 0) > 0 THEN avg(tv) FILTER (WHERE dist = 0)
        ELSE sum(tv / dist) / sum(1 / dist) END AS imp FROM p WHERE rk <= 5 GROUP BY 1, 2)
SELECT d.series_id, d.ts, coalesce(d.temperature, e.imp) AS temperature
FROM d LEFT JOIN e ON d.series_id = e.series_id AND d.ts = e.ts""", ["series_id", "ts"], ["temperature"])


@register("knn_impute", KNN_SQL)
def q_knn_impute(spark, sf_dir):
    w = V.ev_weather(spark, sf_dir)
    d = w.select("series_id", "ts", F.when(F.col("humidity") > 10, F.col("temperature")).alias("temperature"),
                 "pressure", "humidity")
    d = d.withColumn("row_key", F.concat_ws("|", "series_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return FL.knn_impute(d, "row_key", ["temperature", "pressure", "humidity"], 5, group="series_id").select(
        "series_id", "ts", "temperature")


# Two columns missing in different rows: distances over the columns both rows have.
_SHARED_IN = f"""(SELECT series_id, ts, CASE WHEN humidity > 10 THEN temperature END AS temperature,
   CASE WHEN hour(ts) % 5 <> 0 THEN pressure END AS pressure, humidity FROM {V.EV_WEATHER_SQL} AS w)"""
_ROW_SQL = "series_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')"


def _nan_knn_sql(target: str, cols: list[str], source: str, k: int = 5) -> str:
    """(series_id, ts, imp): brute force over all pairs of a series."""
    both = " + ".join(f"CASE WHEN h.{c} IS NOT NULL AND o.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in cols)
    square = " + ".join(f"coalesce((h.{c} - o.{c}) ^ 2, 0)" for c in cols)
    return f"""(SELECT series_id, ts, coalesce(avg(tv) FILTER (WHERE dist = 0), sum(tv / dist) FILTER (WHERE dist > 0) / sum(1 / dist) FILTER (WHERE dist > 0)) AS imp
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY dist, donor) AS rk
    FROM (SELECT h.series_id, h.ts, o.{target} AS tv, {_ROW_SQL.replace('series_id', 'o.series_id').replace('ts,', 'o.ts,')} AS donor,
            sqrt({square}) * sqrt({float(len(cols))} / nullif({both}, 0)) AS dist
          FROM {source} AS h JOIN {source} AS o ON h.series_id = o.series_id AND h.{target} IS NULL AND o.{target} IS NOT NULL) AS p
    WHERE dist IS NOT NULL) AS q WHERE rk <= {k} GROUP BY 1, 2)"""


_SHARED_COLS = ["temperature", "pressure", "humidity"]
KNN_SHARED_SQL = rounded(f"""
WITH d AS {_SHARED_IN}
SELECT d.series_id, d.ts, coalesce(d.temperature, t.imp) AS temperature, coalesce(d.pressure, p.imp) AS pressure, d.humidity
FROM d LEFT JOIN {_nan_knn_sql('temperature', _SHARED_COLS, 'd')} AS t ON d.series_id = t.series_id AND d.ts = t.ts
       LEFT JOIN {_nan_knn_sql('pressure', _SHARED_COLS, 'd')} AS p ON d.series_id = p.series_id AND d.ts = p.ts""",
    ["series_id", "ts"], _SHARED_COLS)


@register("knn_impute_shared", KNN_SHARED_SQL)
def q_knn_shared(spark, sf_dir):
    """M2 with several missing patterns."""
    w = V.ev_weather(spark, sf_dir)
    d = w.select("series_id", "ts", F.when(F.col("humidity") > 10, F.col("temperature")).alias("temperature"),
                 F.when(F.hour("ts") % 5 != 0, F.col("pressure")).alias("pressure"), "humidity")
    d = d.withColumn("row_key", F.concat_ws("|", "series_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return FL.knn_impute(d, "row_key", _SHARED_COLS, 5, group="series_id").drop("row_key")


# --- M1 with all its steps: W18 -> M2 -> A21 -------------------------------------------
# Stand-in gaps: k_avg is taken away from 3 to 8 o'clock, more than the interpolation reaches.
_GAP_SQL = f"(SELECT series_id, ts, v_avg, CASE WHEN hour(ts) NOT BETWEEN 3 AND 8 THEN k_avg END AS k_avg FROM {GRID_SQL} AS gg)"
CASCADE_COLS_SQL = rounded(f"""
WITH iv AS ({_interp_sql('v_avg', 1, 'time', _GAP_SQL)}), ik AS ({_interp_sql('k_avg', 1, 'time', _GAP_SQL)}),
i AS (SELECT iv.series_id, iv.ts, iv.v_avg, ik.k_avg FROM iv JOIN ik ON iv.series_id = ik.series_id AND iv.ts = ik.ts),
n AS (SELECT i.series_id, i.ts, coalesce(i.v_avg, a.imp) AS v_avg, coalesce(i.k_avg, b.imp) AS k_avg
      FROM i LEFT JOIN {_nan_knn_sql('v_avg', ['v_avg', 'k_avg'], 'i')} AS a ON i.series_id = a.series_id AND i.ts = a.ts
             LEFT JOIN {_nan_knn_sql('k_avg', ['v_avg', 'k_avg'], 'i')} AS b ON i.series_id = b.series_id AND i.ts = b.ts),
m AS (SELECT series_id, quantile_cont(v_avg, 0.5) AS mv, quantile_cont(k_avg, 0.5) AS mk FROM n GROUP BY series_id)
SELECT n.series_id, n.ts, coalesce(n.v_avg, m.mv) AS v_avg, coalesce(n.k_avg, m.mk) AS k_avg FROM n JOIN m ON n.series_id = m.series_id""",
    ["series_id", "ts"], ["v_avg", "k_avg"])


@register("fill_cascade_columns", CASCADE_COLS_SQL)
def q_cascade_columns(spark, sf_dir):
    g = grid(spark, sf_dir).select("series_id", "ts", "v_avg", F.when(~F.hour("ts").between(3, 8), F.col("k_avg")).alias("k_avg"))
    return FL.fill_cascade(g, V.HOURLY_SPEC, ["v_avg", "k_avg"], limit=1)

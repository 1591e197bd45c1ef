"""Driver queries for aggregates."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from cirro.functions.grades import regime_label
from cirro.operators import aggregates as A
from cirro.operators.fill import fill_cascade, hourly_grid
from cirro.plans import views as V
from cirro.plans.registry import register, rounded

RAW = V.EV_RAW_SQL
GRID_COLS = ["v_avg", "v_sum", "n", "k_avg"]
GRID_SQL = f"""(WITH h AS {V.EV_HOURLY_SQL},
  r AS (SELECT series_id, min(ts) AS t0, max(ts) AS t1 FROM h GROUP BY series_id),
  g AS (SELECT series_id, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS ts FROM r)
  SELECT g.series_id, g.ts, h.v_avg, h.v_sum, h.n, h.k_avg FROM g LEFT JOIN h
  ON g.series_id = h.series_id AND g.ts = h.ts)"""


def grid(spark, sf_dir):
    return hourly_grid(V.ev_hourly(spark, sf_dir), V.HOURLY_SPEC)


def _nulls_sql(cols):
    return " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in cols)


MISSING_SQL = rounded(f"""
SELECT series_id, CAST(sum({_nulls_sql(GRID_COLS)}) AS BIGINT) AS null_cells,
  CAST(count(*) * 4 AS BIGINT) AS total_cells,
  sum({_nulls_sql(GRID_COLS)}) * 100.0 / (count(*) * 4) AS missing_pct
FROM {GRID_SQL} AS g GROUP BY series_id""", ["series_id", "null_cells", "total_cells"], ["missing_pct"])


@register("missing_profile", MISSING_SQL)
def q_missing(spark, sf_dir):
    return A.missing_profile(grid(spark, sf_dir), ["series_id"], GRID_COLS)


_NONEMPTY = ", ".join(f"count({c}) OVER (PARTITION BY series_id) AS nn_{c}" for c in GRID_COLS)
_AFTER_NULLS = " + ".join(f"CAST({c} IS NULL AND nn_{c} = 0 AS BIGINT)" for c in GRID_COLS)
QUALITY_SQL = rounded(f"""
SELECT series_id, 1 - sum({_nulls_sql(GRID_COLS)}) / (count(*) * 4) AS quality_before,
  1 - sum({_AFTER_NULLS}) / (count(*) * 4) AS quality_after
FROM (SELECT *, {_NONEMPTY} FROM {GRID_SQL} AS g) AS x GROUP BY series_id""",
    ["series_id"], ["quality_before", "quality_after"])


@register("data_quality", QUALITY_SQL)
def q_quality(spark, sf_dir):
    """A2 before and after the fill cascade (interpolation, then the series
    median, which leaves a cell empty only when its whole column is empty)."""
    g = grid(spark, sf_dir)
    after = fill_cascade(g, V.HOURLY_SPEC, GRID_COLS)
    return A.data_quality(g, after, ["series_id"], GRID_COLS)


SUMMARY_SQL = rounded(f"""
SELECT series_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts,
  count(*) FILTER (WHERE x > {V.EVENT_THR_RAW}) AS n_events, arg_max(x, (ts, event_id)) AS last_value
FROM {RAW} GROUP BY series_id""", ["series_id", "n_rows", "first_ts", "last_ts", "n_events"], ["last_value"])


@register("series_summary", SUMMARY_SQL)
def q_summary(spark, sf_dir):
    return A.series_summary(V.ev_raw(spark, sf_dir), V.RAW_SPEC, "x", V.EVENT_THR_RAW)


ONE_MODEL = "m_now"
BALANCE_SQL = rounded(f"""
SELECT series_id, count(*) AS total, CAST(sum(label) AS BIGINT) AS positives,
  sum(label) * 100.0 / count(*) AS positive_pct
FROM {V.SCORED_SQL} AS s WHERE model = '{ONE_MODEL}' GROUP BY series_id""",
    ["series_id", "total", "positives"], ["positive_pct"])


@register("class_balance", BALANCE_SQL)
def q_balance(spark, sf_dir):
    s = V.scored(spark, sf_dir).filter(F.col("model") == ONE_MODEL)
    return A.class_balance(s, ["series_id"], "label")


def _pairs_sql(kind):
    fn = "covar_samp" if kind == "cov" else "corr"
    pairs = list(combinations_with_replacement(GRID_COLS, 2))
    parts = []
    for a, b in pairs:
        v = f"coalesce(CASE WHEN isnan({fn}({a}, {b})) THEN 0 ELSE {fn}({a}, {b}) END, 0)"
        parts.append(f"SELECT series_id, '{a}' AS var_i, '{b}' AS var_j, {v} AS value FROM {V.EV_HOURLY_SQL} AS h GROUP BY series_id")
        if a != b:
            parts.append(f"SELECT series_id, '{b}' AS var_i, '{a}' AS var_j, {v} AS value FROM {V.EV_HOURLY_SQL} AS h GROUP BY series_id")
    return rounded(" UNION ALL ".join(parts), ["series_id", "var_i", "var_j"], ["value"])


@register("covariance_long", _pairs_sql("cov"))
def q_cov(spark, sf_dir):
    return A.pair_stats_long(V.ev_hourly(spark, sf_dir), ["series_id"], GRID_COLS, "cov")


@register("correlation_long", _pairs_sql("corr"))
def q_corr(spark, sf_dir):
    return A.pair_stats_long(V.ev_hourly(spark, sf_dir), ["series_id"], GRID_COLS, "corr")


_RET = f"""(SELECT series_id, ts,
   CASE WHEN lag(1) OVER (PARTITION BY series_id ORDER BY ts) IS NULL THEN NULL
        ELSE (coalesce(amount, 0) - coalesce(lag(amount) OVER (PARTITION BY series_id ORDER BY ts), 0))
             / (coalesce(lag(amount) OVER (PARTITION BY series_id ORDER BY ts), 0) + 1e-10) END AS r
 FROM {V.ORDERS_DAILY_SQL} AS o)"""
RETURN_SQL = rounded(f"""
SELECT series_id, count(*) AS n, coalesce(avg(r), 0) AS mean_return, coalesce(stddev_pop(r), 0) AS volatility,
  CASE WHEN count(*) >= 2 AND coalesce(stddev_pop(r), 0) > 1e-10
       THEN (avg(r) - 0.01 / count(*)) / stddev_pop(r) ELSE 0 END AS sharpe
FROM {_RET} AS t GROUP BY series_id""", ["series_id", "n"], ["mean_return", "volatility", "sharpe"])


@register("return_stats", RETURN_SQL)
def q_returns(spark, sf_dir):
    return A.return_stats(V.orders_daily(spark, sf_dir), V.DAILY_SPEC, "amount")


_DD = """greatest(0, least(1, (max(coalesce(amount, 0)) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
 - coalesce(amount, 0)) / (max(coalesce(amount, 0)) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1e-10)))"""
MAXDD_SQL = rounded(f"""
SELECT series_id, max(dd) AS max_drawdown, arg_max(dd, ts) AS current_drawdown
FROM (SELECT series_id, ts, {_DD} AS dd FROM {V.ORDERS_DAILY_SQL} AS o) AS t GROUP BY series_id""",
    ["series_id"], ["max_drawdown", "current_drawdown"])


@register("max_drawdown", MAXDD_SQL)
def q_maxdd(spark, sf_dir):
    return A.max_drawdown(V.orders_daily(spark, sf_dir), V.DAILY_SPEC, "amount")


SPREAD_SQL = rounded(f"""
SELECT series_id, ts, event_id, min(p) AS p_min, max(p) AS p_max,
  quantile_cont(p, 0.25) AS p25, quantile_cont(p, 0.5) AS p50, quantile_cont(p, 0.75) AS p75,
  avg(p) AS p_mean, stddev_pop(p) AS p_std, max(p) - min(p) AS p_range, count(p) AS n_models
FROM {V.SCORED_SQL} AS s GROUP BY series_id, ts, event_id""", ["series_id", "ts", "event_id", "n_models"],
    ["p_min", "p_max", "p25", "p50", "p75", "p_mean", "p_std", "p_range"])


@register("ensemble_spread", SPREAD_SQL)
def q_spread(spark, sf_dir):
    return A.ensemble_spread(V.scored(spark, sf_dir), ["series_id", "ts", "event_id"])


MOMENTS_SQL = rounded(f"""
WITH s AS (SELECT series_id, ts, event_id, p, avg(p) OVER (PARTITION BY series_id, ts, event_id) AS mu,
                  count(p) OVER (PARTITION BY series_id, ts, event_id) AS n FROM {V.SCORED_SQL} AS q)
SELECT series_id, ts, event_id, avg(p) AS p_mean, stddev_pop(p) AS p_std,
  CASE WHEN max(n) > 2 AND max(p) > min(p) THEN avg((p - mu) ^ 3) / pow(avg((p - mu) ^ 2), 1.5) END AS p_skew,
  CASE WHEN max(n) > 3 AND max(p) > min(p) THEN avg((p - mu) ^ 4) / pow(avg((p - mu) ^ 2), 2) - 3 END AS p_kurt
FROM s GROUP BY series_id, ts, event_id""", ["series_id", "ts", "event_id"], ["p_mean", "p_std", "p_skew", "p_kurt"])


@register("ensemble_moments", MOMENTS_SQL)
def q_moments(spark, sf_dir):
    return A.ensemble_moments(V.scored(spark, sf_dir), ["series_id", "ts", "event_id"])


WEIGHTS_SQL = rounded(f"""
WITH g AS (SELECT series_id, label, count(*) AS n_class FROM {V.SCORED_SQL} AS s
           WHERE model = '{ONE_MODEL}' GROUP BY series_id, label)
SELECT series_id, label, n_class, sum(n_class) OVER (PARTITION BY series_id) / (2.0 * n_class) AS weight FROM g""",
    ["series_id", "label", "n_class"], ["weight"])


@register("class_weights", WEIGHTS_SQL)
def q_weights(spark, sf_dir):
    s = V.scored(spark, sf_dir).filter(F.col("model") == ONE_MODEL)
    return A.class_weights(s, ["series_id"], "label")


# Bin edges for the daily-distribution report on the events view (daily totals
# of the event value; the reference's chart names rain amounts 0-0.1, 0.1-0.5, ...).
DAILY_EDGES = [0.0, 100.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0, 100000.0]
_EDGE_SQL = "[" + ", ".join(str(e) for e in DAILY_EDGES[1:]) + "]"
DAILY_SQL = rounded(f"""
WITH d AS (SELECT series_id, CAST(ts AS DATE) AS day, sum(x) AS total FROM {RAW} AS r GROUP BY 1, 2),
b AS (SELECT series_id, CAST(len(list_filter({_EDGE_SQL}, lambda e: e <= total)) AS INTEGER) AS bin FROM d)
SELECT series_id, bin, CAST([{", ".join(str(e) for e in DAILY_EDGES)}][bin + 1] AS DOUBLE) AS bin_low,
  count(*) AS days, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY series_id) AS pct_days
FROM b GROUP BY series_id, bin""", ["series_id", "bin", "days"], ["bin_low", "pct_days"])


@register("daily_distribution", DAILY_SQL)
def q_daily(spark, sf_dir):
    import cirro.operators.aggregates as AA
    raw = V.ev_raw(spark, sf_dir)
    return AA.daily_distribution(raw, V.RAW_SPEC, "x", DAILY_EDGES)


STAB_SQL = rounded(f"""
WITH s AS (SELECT series_id, ts, event_id,
   CASE WHEN p < 0.3 THEN 0 WHEN p < 0.7 THEN 1 ELSE 2 END AS state FROM {V.SCORED_SQL} AS q WHERE model = 'm_mean6'),
c AS (SELECT series_id, coalesce(CAST(state <> lag(state) OVER (PARTITION BY series_id ORDER BY ts, event_id) AS INTEGER), 0) AS chg FROM s)
SELECT series_id, CAST(sum(chg) AS BIGINT) AS state_changes, count(*) AS n,
  1 - sum(chg) / greatest(count(*), 1) AS stability FROM c GROUP BY series_id""",
    ["series_id", "state_changes", "n"], ["stability"])


@register("regime_stability", STAB_SQL)
def q_stability(spark, sf_dir):
    s = V.scored(spark, sf_dir).filter(F.col("model") == "m_mean6")
    s = s.withColumn("state", regime_label(F.col("p")))
    return A.regime_stability(s, V.RAW_SPEC, "state")

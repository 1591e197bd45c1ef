"""Driver queries for the window family (W1-W23, W26) and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirro.operators import windows as W
from cirro.operators import splits
from cirro.plans import views as V
from cirro.plans.features import FLAG_H, FLAG_THR, feature_label
from cirro.plans.registry import register, rounded

RAW = V.EV_RAW_SQL
WR = "PARTITION BY series_id ORDER BY ts, event_id"
WH = "PARTITION BY series_id ORDER BY ts"


def _frame(n: int) -> str:
    return f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


def _gate(expr: str, c: str, n: int, mp: int, win: str = WR) -> str:
    fr = f"OVER ({win} {_frame(n)})"
    inner = f"{expr} {fr}"
    # pandas: a constant window has skew 0 and kurt -3
    if expr.startswith("skewness("):
        inner = (f"CASE WHEN count({c}) {fr} >= 3 AND max({c}) {fr} = min({c}) {fr} THEN 0.0 "
                 f"ELSE {expr} {fr} END")
    elif expr.startswith("kurtosis("):
        inner = (f"CASE WHEN count({c}) {fr} >= 4 AND max({c}) {fr} = min({c}) {fr} THEN -3.0 "
                 f"ELSE {expr} {fr} END")
    return f"CASE WHEN count({c}) {fr} >= {mp} THEN {inner} END"


# --- flagship ------------------------------------------------------------------
_FL_DOUBLES = ["v_avg", "v_avg_lag_3"] + [f"v_avg_{s}_6" for s in
                                          ("mean", "std", "min", "max", "skew", "kurt")]
FEATURE_LABEL_SQL = rounded(f"""
SELECT series_id, ts, v_avg,
  lag(v_avg, 3) OVER ({WH}) AS v_avg_lag_3,
  {_gate('avg(v_avg)', 'v_avg', 6, 1, WH)} AS v_avg_mean_6,
  {_gate('stddev_samp(v_avg)', 'v_avg', 6, 1, WH)} AS v_avg_std_6,
  {_gate('min(v_avg)', 'v_avg', 6, 1, WH)} AS v_avg_min_6,
  {_gate('max(v_avg)', 'v_avg', 6, 1, WH)} AS v_avg_max_6,
  {_gate('skewness(v_avg)', 'v_avg', 6, 1, WH)} AS v_avg_skew_6,
  {_gate('kurtosis(v_avg)', 'v_avg', 6, 1, WH)} AS v_avg_kurt_6,
  CAST(CASE WHEN count(*) OVER ({WH} ROWS BETWEEN 1 FOLLOWING AND {FLAG_H} FOLLOWING) >= {FLAG_H}
       THEN CASE WHEN coalesce(sum(v_avg) OVER ({WH} ROWS BETWEEN 1 FOLLOWING AND {FLAG_H} FOLLOWING), 0) > {FLAG_THR}
       THEN 1 ELSE 0 END END AS INTEGER) AS label_next_{FLAG_H}
FROM {V.EV_HOURLY_SQL}""", ["series_id", "ts", f"label_next_{FLAG_H}"], _FL_DOUBLES)


@register("feature_label", FEATURE_LABEL_SQL)
def q_feature_label(spark, sf_dir):
    return feature_label(V.ev_hourly(spark, sf_dir))


# --- W1 ------------------------------------------------------------------------
_LAG_COLS = [f"{c}_lag_{h}" for c in ("x", "k") for h in W.FEATURE_LAGS]
LAGS_SQL = rounded(
    "SELECT series_id, ts, event_id, "
    + ", ".join(f"lag({c}, {h}) OVER ({WR}) AS {c}_lag_{h}" for c in ("x", "k") for h in W.FEATURE_LAGS)
    + f" FROM {RAW}", ["series_id", "ts", "event_id"], _LAG_COLS)


@register("lags", LAGS_SQL)
def q_lags(spark, sf_dir):
    raw = V.ev_raw(spark, sf_dir)
    return W.lags(raw, V.RAW_SPEC, ["x", "k"]).drop("x", "k")


# --- W2-W6 ---------------------------------------------------------------------
_SQL_AGG = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max",
            "skew": "skewness", "kurt": "kurtosis", "sum": "sum"}


def _rolling_sql(stats):
    names, exprs = [], []
    for c in ("x", "k"):
        for n in W.FEATURE_ROLLING:
            for s in stats:
                names.append(f"{c}_{s}_{n}")
                exprs.append(f"{_gate(_SQL_AGG[s] + '(' + c + ')', c, n, W.default_min_periods(n))} AS {c}_{s}_{n}")
    inner = f"SELECT series_id, ts, event_id, {', '.join(exprs)} FROM {RAW}"
    return rounded(inner, ["series_id", "ts", "event_id"], names)


def _rolling_q(stats):
    def q(spark, sf_dir):
        raw = V.ev_raw(spark, sf_dir)
        return W.rolling(raw, V.RAW_SPEC, ["x", "k"], W.FEATURE_ROLLING, stats).drop("x", "k")
    return q


register("rolling_mean", _rolling_sql(["mean"]))(_rolling_q(["mean"]))
register("rolling_std", _rolling_sql(["std"]))(_rolling_q(["std"]))
register("rolling_min_max", _rolling_sql(["min", "max"]))(_rolling_q(["min", "max"]))
register("rolling_skew", _rolling_sql(["skew"]))(_rolling_q(["skew"]))
register("rolling_kurt", _rolling_sql(["kurt"]))(_rolling_q(["kurt"]))


# --- W7 ------------------------------------------------------------------------
def _panel_sql():
    names, exprs = [], []
    for n in W.PANEL_WINDOWS:
        for s in ("mean", "std", "min", "max"):
            names.append(f"x_{s}_{n}")
            exprs.append(f"CASE WHEN count(*) OVER (PARTITION BY series_id) > {n} THEN "
                         f"coalesce({_SQL_AGG[s]}(x) OVER ({WR} {_frame(n)}), 0) END AS x_{s}_{n}")
    return rounded(f"SELECT series_id, ts, event_id, {', '.join(exprs)} FROM {RAW}",
                   ["series_id", "ts", "event_id"], names)


@register("rolling_panel", _panel_sql())
def q_rolling_panel(spark, sf_dir):
    raw = V.ev_raw(spark, sf_dir).drop("k")
    return W.rolling_panel(raw, V.RAW_SPEC, ["x"]).drop("x")


# --- W8 / W16 ------------------------------------------------------------------
DIFFS_SQL = rounded(
    "SELECT series_id, ts, event_id, "
    + ", ".join(f"{c} - lag({c}, {h}) OVER ({WR}) AS {c}_diff_{h}" for c in ("x", "k") for h in W.FEATURE_DIFFS)
    + f" FROM {RAW}", ["series_id", "ts", "event_id"],
    [f"{c}_diff_{h}" for c in ("x", "k") for h in W.FEATURE_DIFFS])


@register("diffs", DIFFS_SQL)
def q_diffs(spark, sf_dir):
    return W.diffs(V.ev_raw(spark, sf_dir), V.RAW_SPEC, ["x", "k"]).drop("x", "k")


TENDENCY_SQL = rounded(
    "SELECT series_id, ts, v_avg - lag(v_avg, 6) OVER (" + WH + ") AS v_avg_tendency_6, "
    "v_avg - lag(v_avg, 24) OVER (" + WH + ") AS v_avg_tendency_24 FROM " + V.EV_HOURLY_SQL,
    ["series_id", "ts"], ["v_avg_tendency_6", "v_avg_tendency_24"])


@register("pressure_tendency", TENDENCY_SQL)
def q_tendency(spark, sf_dir):
    h = V.ev_hourly(spark, sf_dir).select("series_id", "ts", "v_avg")
    return W.diffs(h, V.HOURLY_SPEC, ["v_avg"], W.TENDENCY_HOURS, "tendency").drop("v_avg")


# --- W9 ------------------------------------------------------------------------
ACCEL_SQL = rounded(
    f"SELECT series_id, ts, event_id, "
    f"x - 2 * lag(x, 6) OVER ({WR}) + lag(x, 12) OVER ({WR}) AS x_accel_6, "
    f"coalesce(x - lag(x, 1) OVER ({WR}), 0) AS x_roc_1, "
    f"coalesce(x - 2 * lag(x, 1) OVER ({WR}) + lag(x, 2) OVER ({WR}), 0) AS x_accel_1 FROM {RAW}",
    ["series_id", "ts", "event_id"], ["x_accel_6", "x_roc_1", "x_accel_1"])


@register("acceleration", ACCEL_SQL)
def q_acceleration(spark, sf_dir):
    raw = V.ev_raw(spark, sf_dir).drop("k")

    def build(sw):
        a6 = W.accel_cols(sw, ["x"], 6)
        a1 = W.accel_cols(sw, ["x"], 1)[0][1]
        roc = W.diff_cols(sw, ["x"], [1])[0][1]
        return a6 + [("x_roc_1", F.coalesce(roc, F.lit(0.0))),
                     ("x_accel_1", F.coalesce(a1, F.lit(0.0)))]
    from cirro.plans.layout import run_windows
    return run_windows(raw, V.RAW_SPEC, build, lookback=12).drop("x")


# --- W10 / W11 -------------------------------------------------------------------
def _rain_sql():
    names, exprs = [], []
    for n in W.RAIN_WINDOWS:
        for s, a in (("sum", "sum"), ("max", "max"), ("std", "stddev_samp")):
            names.append(f"rain_{s}_{n}")
            exprs.append(f"{_gate(a + '(x)', 'x', n, 1)} AS rain_{s}_{n}")
    return rounded(f"SELECT series_id, ts, event_id, {', '.join(exprs)} FROM {RAW}",
                   ["series_id", "ts", "event_id"], names)


@register("rain_totals", _rain_sql())
def q_rain_totals(spark, sf_dir):
    return W.rain_totals(V.ev_raw(spark, sf_dir), V.RAW_SPEC, "x").drop("x", "k")


def _acc_sql():
    names, exprs = [], []
    for n in W.PANEL_WINDOWS:
        for s, a in (("acc", "sum"), ("max", "max")):
            names.append(f"{s}_{n}")
            exprs.append(f"CASE WHEN count(*) OVER (PARTITION BY series_id) > {n} THEN "
                         f"coalesce({a}(x) OVER ({WR} {_frame(n)}), 0) END AS {s}_{n}")
    return rounded(f"SELECT series_id, ts, event_id, {', '.join(exprs)} FROM {RAW}",
                   ["series_id", "ts", "event_id"], names)


@register("accumulations", _acc_sql())
def q_accumulations(spark, sf_dir):
    return W.accumulations(V.ev_raw(spark, sf_dir).drop("k"), V.RAW_SPEC, "x").drop("x")


# --- W12 -----------------------------------------------------------------------
CORR_SQL = rounded(
    f"SELECT series_id, ts, event_id, CASE WHEN count(CASE WHEN x IS NOT NULL AND k IS NOT NULL THEN 1 END) "
    f"OVER ({WR} {_frame(72)}) >= 72 THEN corr(x, k) OVER ({WR} {_frame(72)}) END AS corr_x_k_72 FROM {RAW}",
    ["series_id", "ts", "event_id"], ["corr_x_k_72"])


@register("rolling_corr", CORR_SQL)
def q_rolling_corr(spark, sf_dir):
    return W.rolling_corr(V.ev_raw(spark, sf_dir), V.RAW_SPEC, [("x", "k")], 72).drop("x", "k")


# --- W13 -----------------------------------------------------------------------
HOURS_SINCE_SQL = f"""
SELECT series_id, ts, event_id,
  CAST(row_number() OVER ({WR}) - coalesce(max(CASE WHEN x > {V.EVENT_THR_RAW} THEN rn END)
       OVER ({WR} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS hours_since_event
FROM (SELECT *, row_number() OVER ({WR}) AS rn FROM {RAW}) AS t"""


@register("hours_since", HOURS_SINCE_SQL)
def q_hours_since(spark, sf_dir):
    raw = V.ev_raw(spark, sf_dir).drop("k")
    return W.hours_since(raw, V.RAW_SPEC, "x", V.EVENT_THR_RAW).drop("x")


# --- W14 -----------------------------------------------------------------------
def _dd_sql(c):
    return (f"greatest(0, least(1, (max(coalesce({c}, 0)) OVER ({WR} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            f" - coalesce({c}, 0)) / (max(coalesce({c}, 0)) OVER ({WR} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1e-10)))")


DRAWDOWN_SQL = rounded(
    f"SELECT series_id, ts, event_id, {_dd_sql('x')} AS x_drawdown, {_dd_sql('k')} AS k_drawdown FROM {RAW}",
    ["series_id", "ts", "event_id"], ["x_drawdown", "k_drawdown"])


@register("drawdown", DRAWDOWN_SQL)
def q_drawdown(spark, sf_dir):
    return W.drawdown(V.ev_raw(spark, sf_dir), V.RAW_SPEC, ["x", "k"]).drop("x", "k")


# --- W15 -----------------------------------------------------------------------
TREND_SQL = rounded(
    "SELECT series_id, ts, event_id, "
    + ", ".join(f"x - avg(x) OVER ({WR} {_frame(n)}) AS x_trend_{n}" for n in (3, 6, 12, 24))
    + f" FROM {RAW}", ["series_id", "ts", "event_id"], [f"x_trend_{n}" for n in (3, 6, 12, 24)])


@register("trend", TREND_SQL)
def q_trend(spark, sf_dir):
    return W.trend(V.ev_raw(spark, sf_dir).drop("k"), V.RAW_SPEC, ["x"]).drop("x")


# --- W19 / W20 / W21 -------------------------------------------------------------
def _fut(c, h, thr, need, win=WR):
    return (f"CAST(CASE WHEN count(*) OVER ({win} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) >= {need} "
            f"THEN CASE WHEN coalesce(sum({c}) OVER ({win} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING), 0) > {thr} "
            f"THEN 1 ELSE 0 END END AS INTEGER)")


FUTURE_LABEL_SQL = (f"SELECT series_id, ts, event_id, {_fut('x', V.LABEL_H_RAW, V.LABEL_THR_RAW, V.LABEL_H_RAW)} AS label_next_6, "
                    f"{_fut('x', V.LABEL_H_RAW, V.LABEL_THR_RAW, 1)} AS label_next_6_partial FROM {RAW}")


@register("future_label", FUTURE_LABEL_SQL)
def q_future_label(spark, sf_dir):
    raw = V.ev_raw(spark, sf_dir).drop("k")
    from cirro.plans.layout import run_windows
    return run_windows(raw, V.RAW_SPEC, lambda sw: [
        ("label_next_6", W.future_label_col(sw, "x", V.LABEL_H_RAW, V.LABEL_THR_RAW)),
        ("label_next_6_partial", W.future_label_col(sw, "x", V.LABEL_H_RAW, V.LABEL_THR_RAW, True)),
    ], lookahead=V.LABEL_H_RAW).drop("x")


FUTURE_POINT_SQL = (f"SELECT series_id, ts, event_id, CAST(coalesce(lead(x, 6) OVER ({WR}) > {V.EVENT_THR_RAW}, false) "
                    f"AS INTEGER) AS label_at_6 FROM {RAW}")


@register("future_point_label", FUTURE_POINT_SQL)
def q_future_point(spark, sf_dir):
    raw = V.ev_raw(spark, sf_dir).drop("k")
    return W.future_point_label(raw, V.RAW_SPEC, "x", 6, V.EVENT_THR_RAW).drop("x")


ALT_LABEL_SQL = f"""
WITH l AS (SELECT series_id, ts, v_avg,
   {_fut('v_avg', 24, 2000, 24, WH)} AS y_main,
   {_fut('v_avg', 24, 1000, 24, WH)} AS y_alt FROM {V.EV_HOURLY_SQL}),
c AS (SELECT series_id, count(DISTINCT y_main) AS k FROM l GROUP BY series_id)
SELECT l.series_id, l.ts, CAST(CASE WHEN c.k < 2 THEN y_alt ELSE y_main END AS INTEGER) AS label,
       CASE WHEN c.k < 2 THEN 'alternative' ELSE 'primary' END AS label_rule
FROM l JOIN c ON l.series_id = c.series_id"""


@register("alternative_label", ALT_LABEL_SQL)
def q_alt_label(spark, sf_dir):
    h = V.ev_hourly(spark, sf_dir).select("series_id", "ts", "v_avg")
    return splits.alternative_label(h, V.HOURLY_SPEC, "v_avg", 24, 2000.0, 1000.0).drop("v_avg")


# --- W22 / W23 / W26 ------------------------------------------------------------
SPLIT_SQL = f"""
SELECT series_id, ts, event_id,
  CASE WHEN rn <= floor(0.6 * n) THEN 'train' WHEN rn <= floor(0.8 * n) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT series_id, ts, event_id, row_number() OVER ({WR}) AS rn,
             count(*) OVER (PARTITION BY series_id) AS n FROM {RAW}) AS t"""


@register("chronological_split", SPLIT_SQL)
def q_split(spark, sf_dir):
    return splits.chronological_split(V.ev_raw(spark, sf_dir), V.RAW_SPEC).drop("x", "k")


FOLDS_SQL = f"""
WITH t AS (SELECT series_id, ts, event_id, row_number() OVER ({WR}) AS rn,
                  count(*) OVER (PARTITION BY series_id) AS n FROM {RAW}),
f AS (SELECT * FROM (VALUES (0), (1), (2)) AS v(fold))
SELECT t.series_id, t.ts, t.event_id, CAST(f.fold AS INTEGER) AS fold,
       CASE WHEN t.rn <= t.n - (3 - f.fold) * (t.n // 4) THEN 'train' ELSE 'test' END AS role
FROM t JOIN f ON t.rn <= t.n - (2 - f.fold) * (t.n // 4)"""


@register("time_folds", FOLDS_SQL)
def q_folds(spark, sf_dir):
    return splits.time_folds(V.ev_raw(spark, sf_dir), V.RAW_SPEC, 3).drop("x", "k")


LATEST_SQL = rounded(f"""
SELECT series_id, ts, event_id, x FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, event_id DESC) AS r
FROM {RAW}) AS t WHERE r <= 168""", ["series_id", "ts", "event_id"], ["x"])


@register("latest", LATEST_SQL)
def q_latest(spark, sf_dir):
    return splits.latest(V.ev_raw(spark, sf_dir), V.RAW_SPEC, 168).drop("k")

"""Driver queries for preparation and models.

Model outputs have no SQL oracle (the driver records a rows-only check);
the scalers have one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cirro.operators import models as ML
from cirro.plans import training as TR
from cirro.plans import views as V
from cirro.plans.registry import register, rounded

_CACHE: dict = {}


def trained(spark, sf_dir):
    """Train once per (session, data folder) within a process."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = TR.train(spark, sf_dir)
    return _CACHE[key]


@register("train_ensemble")
def q_train(spark, sf_dir):
    """Tuned learners, calibration, selection and stack; test metrics."""
    return TR.test_metrics(trained(spark, sf_dir))


@register("score_latest")
def q_score_latest(spark, sf_dir):
    """Forecast record of the latest row of every series."""
    from cirro.operators.aggregates import missing_profile
    from cirro.plans.q_aggregates import GRID_COLS, grid
    mp = missing_profile(grid(spark, sf_dir), ["series_id"], GRID_COLS)
    quality = mp.select("series_id", (1 - F.col("null_cells") / F.col("total_cells")).alias("quality"))
    volatility = q_regimes(spark, sf_dir).select("series_id", "ts", "volatile_prob")
    return TR.score_latest(trained(spark, sf_dir), quality, volatility)


@register("export_importance")
def q_importance(spark, sf_dir):
    """Top-20 random-forest importances (true top k)."""
    t = trained(spark, sf_dir)
    m = t.models.get("rf")
    shares = m.importances() if hasattr(m, "importances") else []
    rows = sorted(((c, float(v)) for c, v in zip(t.feature_cols, shares)), key=lambda x: (-x[1], x[0]))[:20]
    return spark.createDataFrame([(i + 1, c, v) for i, (c, v) in enumerate(rows)],
                                 "rank int, feature string, importance double")


_STD_COLS = ["temperature", "humidity", "pressure", "wind_speed"]
STD_SQL = rounded(f"""
SELECT w.series_id, w.ts, w.precipitation, w.cloud_cover, w.wind_direction,
  {", ".join(f"CASE WHEN s.sd_{c} > 0 THEN (w.{c} - s.mu_{c}) / s.sd_{c} ELSE 0.0 END AS {c}" for c in _STD_COLS)}
FROM {V.EV_WEATHER_SQL} AS w JOIN (SELECT series_id, {", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in _STD_COLS)}
  FROM {V.EV_WEATHER_SQL} AS x GROUP BY 1) AS s ON w.series_id = s.series_id""", ["series_id", "ts"],
    ["precipitation", "cloud_cover", "wind_direction", *_STD_COLS])


@register("standardize", STD_SQL)
def q_standardize(spark, sf_dir):
    return ML.standardize(V.ev_weather(spark, sf_dir), ["series_id"], _STD_COLS)


ROBUST_SQL = rounded(f"""
WITH w AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY series_id) AS n
           FROM {V.EV_WEATHER_SQL} AS x),
q AS (SELECT series_id, {", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in _STD_COLS)}
      FROM w WHERE rn <= floor(0.6 * n) GROUP BY 1)
SELECT w.series_id, w.ts, {", ".join(f"(w.{c} - q.m_{c}) / CASE WHEN q.b_{c} - q.a_{c} <> 0 THEN q.b_{c} - q.a_{c} ELSE 1.0 END AS {c}" for c in _STD_COLS)}
FROM w JOIN q ON w.series_id = q.series_id""", ["series_id", "ts"], _STD_COLS)


@register("robust_scale", ROBUST_SQL)
def q_robust(spark, sf_dir):
    from cirro.operators.splits import chronological_split
    w = V.ev_weather(spark, sf_dir).select("series_id", "ts", *_STD_COLS)
    s = chronological_split(w, V.HOURLY_SPEC).withColumn("is_train", F.col("split") == "train")
    return ML.robust_scale(s, ["series_id"], _STD_COLS, "is_train").drop("split", "is_train")


@register("pca_report")
def q_pca_report(spark, sf_dir):
    """M5: explained and cumulative variance of the standardised variables."""
    w = V.ev_weather(spark, sf_dir)
    _, report, _ = ML.pca_report(w, V.WEATHER_COLS, 5)
    return report


@register("export_components")
def q_components(spark, sf_dir):
    """Component scores PC1..PC5 per row."""
    w = V.ev_weather(spark, sf_dir)
    scores, _, _ = ML.pca_report(w, V.WEATHER_COLS, 5)
    return scores


@register("pca_features")
def q_pca_features(spark, sf_dir):
    """M4: five components of the unscaled variables, fitted on the first 60 % of each series."""
    from cirro.operators.splits import chronological_split
    w = chronological_split(V.ev_weather(spark, sf_dir), V.HOURLY_SPEC).withColumn("is_train", F.col("split") == "train")
    return ML.pca_features(w, V.WEATHER_COLS, 5, fit_mask="is_train").drop("split", "is_train")


GUARD_SQL = rounded(f"SELECT series_id, ts, 0.0 AS rf, 0.0 AS xgb, 0.0 AS lr, 0.0 AS mlp FROM {V.EV_WEATHER_SQL} AS w", ["series_id", "ts"], ["rf", "xgb", "lr", "mlp"])


@register("single_class_guard", GUARD_SQL)
def q_single_class(spark, sf_dir):
    """Learners that see rows without the event say 0 everywhere."""
    from cirro.operators import programs as P
    from cirro.operators.search import fit_many
    cols = ["temperature", "humidity", "pressure"]
    w = V.ev_weather(spark, sf_dir)
    rows = w.filter(F.col("precipitation") <= 3).select(F.concat_ws("|", "series_id", "ts").alias("key"), F.lit(0).alias("label"), F.lit(P.TRAIN).alias("r"), *cols)
    kinds = ["rf", "xgb", "lr", "mlp"]
    models = fit_many(P.training_table(rows, cols, "label", "key", ["r"]), [(k, 0, {}) for k in kinds])
    return P.predictions(w, cols, dict(zip(kinds, models))).select("series_id", "ts", *kinds)


# --- A18 / T1 ----------------------------------------------------------------------------
_MI_FEATS = ["x", "k", "x_lag_1", "x_lag_3", "x_mean_6", "x_std_6", "x_diff_1", "k_mean_6"]


def _mi_frame(spark, sf_dir):
    from cirro.operators import windows as W
    from cirro.plans.layout import run_windows
    raw = V.ev_raw(spark, sf_dir)

    def build(sw):
        return (W.lag_cols(sw, ["x"], [1, 3]) + W.rolling_cols(sw, ["x"], [6], ("mean", "std"))
                + W.diff_cols(sw, ["x"], [1]) + W.rolling_cols(sw, ["k"], [6], ("mean",))
                + [("label", W.future_label_col(sw, "x", V.LABEL_H_RAW, V.LABEL_THR_RAW))])
    return run_windows(raw, V.RAW_SPEC, build, lookback=5, lookahead=V.LABEL_H_RAW)


_WR = "PARTITION BY series_id ORDER BY ts, event_id"
_F6 = f"{_WR} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW"
_MI_BASE = f"""(SELECT series_id, x, k, lag(x, 1) OVER ({_WR}) AS x_lag_1, lag(x, 3) OVER ({_WR}) AS x_lag_3,
   CASE WHEN count(x) OVER ({_F6}) >= 1 THEN avg(x) OVER ({_F6}) END AS x_mean_6,
   CASE WHEN count(x) OVER ({_F6}) >= 1 THEN stddev_samp(x) OVER ({_F6}) END AS x_std_6,
   x - lag(x, 1) OVER ({_WR}) AS x_diff_1,
   CASE WHEN count(k) OVER ({_F6}) >= 1 THEN avg(k) OVER ({_F6}) END AS k_mean_6,
   CASE WHEN count(*) OVER ({_WR} ROWS BETWEEN 1 FOLLOWING AND {V.LABEL_H_RAW} FOLLOWING) >= {V.LABEL_H_RAW}
        THEN CASE WHEN coalesce(sum(x) OVER ({_WR} ROWS BETWEEN 1 FOLLOWING AND {V.LABEL_H_RAW} FOLLOWING), 0) > {V.LABEL_THR_RAW}
        THEN 1 ELSE 0 END END AS label FROM {V.EV_RAW_SQL} AS r)"""
_MI_INNER = f"""
WITH b AS {_MI_BASE},
l AS ({" UNION ALL ".join(f"SELECT series_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS v, label FROM b WHERE label IS NOT NULL AND {c} IS NOT NULL" for c in _MI_FEATS)}),
r AS (SELECT series_id, feature, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1, 2),
c AS (SELECT l.series_id, l.feature, CASE WHEN r.hi - r.lo > 0 THEN least(floor((l.v - r.lo) / (r.hi - r.lo) * 10), 9) ELSE 0 END AS bin,
        l.label, count(*) AS cnt FROM l JOIN r ON l.series_id = r.series_id AND l.feature = r.feature GROUP BY 1, 2, 3, 4),
t AS (SELECT series_id, feature, cnt / sum(cnt) OVER (PARTITION BY series_id, feature)
        * ln(cnt * sum(cnt) OVER (PARTITION BY series_id, feature)
             / (sum(cnt) OVER (PARTITION BY series_id, feature, bin) * sum(cnt) OVER (PARTITION BY series_id, feature, label))) AS term FROM c)
SELECT series_id, feature, sum(term) AS mi FROM t GROUP BY 1, 2"""
MI_SQL = rounded(_MI_INNER, ["series_id", "feature"], ["mi"])


@register("mutual_information", MI_SQL)
def q_mi(spark, sf_dir):
    from cirro.operators.selection import mutual_information
    return mutual_information(_mi_frame(spark, sf_dir), ["series_id"], _MI_FEATS, "label", 10)


TOPF_SQL = rounded(f"""
SELECT series_id, feature, mi, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mi DESC, feature) AS rank,
         count(*) OVER (PARTITION BY series_id) AS nf FROM ({_MI_INNER}) AS m) AS z
WHERE rank <= least(150, greatest(50, floor(nf * 0.3)))""", ["series_id", "feature", "rank"], ["mi"])


@register("top_features", TOPF_SQL)
def q_top_features(spark, sf_dir):
    from cirro.operators.selection import mutual_information, top_features
    mi = mutual_information(_mi_frame(spark, sf_dir), ["series_id"], _MI_FEATS, "label", 10)
    return top_features(mi, ["series_id"])


# --- M8 / M10 ------------------------------------------------------------------------------
_REG_COLS = ["pressure", "temperature", "humidity"]


def _hidden(spark, sf_dir):
    from cirro.operators.hidden_states import hidden_states
    w = V.ev_weather(spark, sf_dir).select("series_id", "ts", *_REG_COLS)
    return hidden_states(w, V.HOURLY_SPEC, _REG_COLS, 3)


@register("regime_posteriors")
def q_regimes(spark, sf_dir):
    """M8: smoothed state posteriors and volatile_prob per hourly row."""
    return _hidden(spark, sf_dir).drop("state")


@register("hard_state")
def q_hard_state(spark, sf_dir):
    """State on the most likely path (3 states) and the two-state volatile flag."""
    from cirro.operators.hidden_states import two_states
    w = V.ev_weather(spark, sf_dir).select("series_id", "ts", *_REG_COLS[:2])
    two = two_states(w, V.HOURLY_SPEC, _REG_COLS[:2]).select("series_id", "ts", "volatile")
    return _hidden(spark, sf_dir).select("series_id", "ts", "state").join(two, ["series_id", "ts"])


@register("state_stability")
def q_state_stability(spark, sf_dir):
    """A22 on the most likely path."""
    from cirro.operators.aggregates import regime_stability
    return regime_stability(_hidden(spark, sf_dir), V.HOURLY_SPEC, "state")


# --- T3 / T4 / M11 --------------------------------------------------------------------------
def _labelled(spark, sf_dir):
    from cirro.operators import windows as W
    from cirro.operators.splits import chronological_split
    w = V.ev_weather(spark, sf_dir)
    lab = W.future_label(w, V.HOURLY_SPEC, "precipitation", TR.HORIZON, TR.RAIN_THR, name="label")
    lab = lab.filter(F.col("label").isNotNull())
    return chronological_split(lab, V.HOURLY_SPEC)


@register("balanced_subset")
def q_balanced(spark, sf_dir):
    """T4: validation rows subsampled to the training positive share."""
    from cirro.operators.sampling import balanced_subset
    s = _labelled(spark, sf_dir)
    rate = s.filter(F.col("split") == "train").agg(F.avg("label")).first()[0]
    return balanced_subset(s.filter(F.col("split") == "validation"), float(rate), ["series_id", "ts"])


def _synthetic(spark, sf_dir):
    from cirro.operators.sampling import oversample_minority
    s = _labelled(spark, sf_dir).filter(F.col("split") == "train")
    s = s.withColumn("row_key", F.concat_ws("|", "series_id", F.col("ts").cast("string")))
    z = ML.standardize(s, ["series_id"], ["pressure", "temperature", "humidity"])
    feats = ["pressure", "temperature", "humidity", "wind_speed", "cloud_cover"]
    syn = oversample_minority(z, "row_key", feats, "label", 5)
    return z, syn, feats


@register("oversample_minority")
def q_oversample(spark, sf_dir):
    """Synthetic minority rows (5 nearest minority neighbours)."""
    return _synthetic(spark, sf_dir)[1]


@register("append_synthetic")
def q_append(spark, sf_dir):
    """Training rows plus synthetic rows; classes end balanced."""
    from cirro.operators.sampling import append_synthetic
    z, syn, feats = _synthetic(spark, sf_dir)
    return append_synthetic(z.select(*feats, "label"), syn)

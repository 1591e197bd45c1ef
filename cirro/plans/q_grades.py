"""Driver query for the prediction grades.

For every scored row: the ensemble probability (median of the models),
the conformal interval from the series' 80 % quantile of |p - y|, the
tuned and clamped threshold, the outcome, the confidence grade, the
trust score, the three-level outcome, the first version's confidence
and its weighted vote.  Per-series inputs (quantile, threshold, AUCs,
F1, data quality) are small aggregates joined back by series.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cirro.functions import grades as GR
from cirro.operators import metrics as M
from cirro.operators.aggregates import missing_profile
from cirro.plans import views as V
from cirro.plans.q_aggregates import GRID_COLS, GRID_SQL, _nulls_sql, grid
from cirro.plans.q_metrics import MODELS, STEP, _fb
from cirro.plans.registry import register, rounded

KEY = ["series_id", "ts", "event_id"]


def graded(spark, sf_dir):
    from cirro.session import cut_lineage
    # the scores and the ensemble feed six per-series aggregates each:
    # materialise them once in the checkpoint folder
    s = cut_lineage(V.scored(spark, sf_dir))
    ens = s.groupBy(*KEY).agg(
        F.percentile("p", 0.5).alias("p_ens"), (F.max("p") - F.min("p")).alias("p_range"),
        F.count("p").alias("n_models"), F.stddev_pop("p").alias("p_std"), F.first("label").alias("label"),
        *[F.max(F.when(F.col("model") == m, F.col("p"))).alias(m) for m in MODELS])
    ens = cut_lineage(ens)
    q = M.conformal_quantile(ens, ["series_id"], p="p_ens")
    thr = M.best_threshold(ens, ["series_id"], p="p_ens").select(
        "series_id", GR.clamp_threshold(F.col("threshold")).alias("threshold"))
    auc = M.auc_roc(ens, ["series_id"], p="p_ens").withColumnRenamed("auc", "auc_ens")
    per_model = M.auc_roc(s, ["series_id", "model"])
    auc_rf = per_model.filter(F.col("model") == "m_now").select("series_id", F.col("auc").alias("auc_rf"))
    auc_xgb = per_model.filter(F.col("model") == "m_mean6").select("series_id", F.col("auc").alias("auc_xgb"))
    f1_gb = (M.class_metrics(M.confusion(s.filter(F.col("model") == "m_mean24"), ["series_id"], thr=0.5))
             .select("series_id", F.col("f1").alias("f1_gb")))
    mp = missing_profile(grid(spark, sf_dir), ["series_id"], GRID_COLS)
    quality = mp.select("series_id", (1 - F.col("null_cells") / F.col("total_cells")).alias("quality"))
    per_series = (q.join(thr, "series_id").join(auc, "series_id").join(auc_rf, "series_id")
                  .join(auc_xgb, "series_id").join(f1_gb, "series_id").join(quality, "series_id"))
    j = ens.join(per_series, "series_id")      # one row per series: broadcast at runtime
    lo, hi, width = GR.conformal_interval(F.col("p_ens"), F.col("conformal_q"))
    conf = GR.confidence_grade(width)
    outcome = F.when(F.col("p_ens") >= F.col("threshold"), "RAIN").otherwise("NO RAIN")
    vol = F.col("m_mean24")
    trust = GR.trust_score(F.col("quality"), width, F.col("p_range"), F.col("n_models"), conf, outcome,
                           F.col("p_ens"), vol)
    v1 = GR.v1_confidence(F.col("p_std"), F.col("auc_ens"), F.col("p_ens"))
    vote = GR.weighted_vote("m_now", "m_mean6", "m_mean24", "auc_rf", "auc_xgb", "f1_gb", vol)
    return j.select(*KEY, "p_ens", lo.alias("lower_ci"), hi.alias("upper_ci"), width.alias("interval_width"),
                    "threshold", outcome.alias("prediction"), conf.alias("confidence"),
                    trust["trust_pct"].alias("trust_pct"), trust["trust_status"].alias("trust_status"),
                    F.array_join(trust["reasons"], "; ").alias("reasons"),
                    GR.outcome_three_level(F.col("p_ens")).alias("outcome3"),
                    GR.regime_label(vol).alias("regime"),
                    v1["confidence_score"].alias("v1_score"), v1["confidence"].alias("v1_confidence"),
                    vote.alias("vote_p"))


_ENS = f"""(SELECT series_id, ts, event_id, quantile_cont(p, 0.5) AS p_ens, max(p) - min(p) AS p_range,
   count(p) AS n_models, stddev_pop(p) AS p_std, first(label) AS label,
   max(p) FILTER (WHERE model = 'm_now') AS m_now, max(p) FILTER (WHERE model = 'm_mean6') AS m_mean6,
   max(p) FILTER (WHERE model = 'm_mean24') AS m_mean24 FROM {V.SCORED_SQL} AS s GROUP BY 1, 2, 3)"""


def _auc_sql(src, pcol, group):
    g = ", ".join(group)
    return f"""(SELECT {g}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc
  FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {g} ORDER BY pv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT {g}, {pcol} AS pv, sum(label) AS pos, count(*) - sum(label) AS neg FROM {src} AS z GROUP BY {g}, {pcol}) AS d) AS c
  GROUP BY {g})"""


_GRID = f"(SELECT i AS j, CASE WHEN i = 98 THEN 0.99 ELSE i * {STEP} + 0.01 END AS t FROM range(99) AS r(i))"
_THR = f"""(SELECT series_id, CASE WHEN max(score) > 0 THEN arg_max(t, (score, -t)) ELSE 0.5 END AS thr0 FROM (
  SELECT series_id, t, {_fb('tp', 'fp', 'fn', 4.0)} AS score FROM (
    SELECT e.series_id, g.t, count(*) FILTER (WHERE e.label = 1 AND e.p_ens >= g.t) AS tp,
      count(*) FILTER (WHERE e.label = 0 AND e.p_ens >= g.t) AS fp, count(*) FILTER (WHERE e.label = 1 AND e.p_ens < g.t) AS fn
    FROM {_ENS} AS e, {_GRID} AS g GROUP BY 1, 2) AS w) AS x GROUP BY series_id)"""
_PER = f"""(SELECT q.series_id, q.cq, CASE WHEN t.thr0 > 0.4 THEN 0.35 WHEN t.thr0 < 0.2 THEN 0.25 ELSE t.thr0 END AS threshold,
   a.auc AS auc_ens, ar.auc AS auc_rf, ax.auc AS auc_xgb, f.f1_gb, m.quality
 FROM (SELECT series_id, quantile_cont(abs(p_ens - label), 0.8) AS cq FROM {_ENS} AS e GROUP BY 1) AS q
 JOIN {_THR} AS t ON q.series_id = t.series_id
 JOIN {_auc_sql(_ENS, 'p_ens', ['series_id'])} AS a ON a.series_id = q.series_id
 JOIN (SELECT * FROM {_auc_sql(V.SCORED_SQL, 'p', ['series_id', 'model'])} AS z WHERE model = 'm_now') AS ar ON ar.series_id = q.series_id
 JOIN (SELECT * FROM {_auc_sql(V.SCORED_SQL, 'p', ['series_id', 'model'])} AS z WHERE model = 'm_mean6') AS ax ON ax.series_id = q.series_id
 JOIN (SELECT series_id, {_fb('tp', 'fp', 'fn', 1.0)} AS f1_gb FROM (SELECT series_id,
        count(*) FILTER (WHERE label = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND p >= 0.5) AS fp,
        count(*) FILTER (WHERE label = 1 AND p < 0.5) AS fn FROM {V.SCORED_SQL} AS s WHERE model = 'm_mean24' GROUP BY 1) AS c) AS f
   ON f.series_id = q.series_id
 JOIN (SELECT series_id, 1 - sum({_nulls_sql(GRID_COLS)}) / (count(*) * 4) AS quality FROM {GRID_SQL} AS g GROUP BY 1) AS m
   ON m.series_id = q.series_id)"""

GRADES_SQL = rounded(f"""
WITH b AS (SELECT e.*, p.*, greatest(0.0, e.p_ens - p.cq) AS lower_ci, least(1.0, e.p_ens + p.cq) AS upper_ci
           FROM {_ENS} AS e JOIN {_PER} AS p ON e.series_id = p.series_id),
c AS (SELECT *, upper_ci - lower_ci AS w, CASE WHEN p_ens >= threshold THEN 'RAIN' ELSE 'NO RAIN' END AS prediction FROM b),
d AS (SELECT *, CASE WHEN w < 0.15 THEN 'VERY HIGH' WHEN w < 0.25 THEN 'HIGH' WHEN w < 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
        CASE WHEN prediction = 'NO RAIN' AND p_ens < 0.2 THEN 1.0 ELSE 0.0 END AS bonus FROM c),
t AS (SELECT *, (CASE WHEN quality > 0.95 THEN 3.0 WHEN quality > 0.9 THEN 2.5 WHEN quality > 0.85 THEN 2.0 ELSE 1.0 END
        + CASE WHEN w < 0.15 THEN 2.0 WHEN w < 0.25 THEN 1.5 WHEN w < 0.35 THEN 1.0 ELSE 0.0 END
        + CASE WHEN n_models >= 2 THEN CASE WHEN p_range < 0.1 THEN 2.0 WHEN p_range < 0.2 THEN 1.5 WHEN p_range < 0.3 THEN 1.0 ELSE 0.0 END ELSE 0.0 END
        + CASE WHEN confidence IN ('VERY HIGH', 'HIGH') THEN 1.0 WHEN confidence = 'MEDIUM' THEN 0.5 ELSE 0.0 END
        + bonus - CASE WHEN m_mean24 > 0.7 THEN 0.5 ELSE 0.0 END) / (8.0 + bonus) * 100 AS trust_pct FROM d),
v AS (SELECT *, 0.4 * (1 - least(p_std, 0.5)) + 0.3 * auc_ens + 0.3 * (abs(p_ens - 0.5) * 2) AS v1_score,
        greatest(0.0, least(1.0, (0.3 * auc_rf * m_now * 1.5 + 0.4 * auc_xgb * m_mean6 * 2.5 + 0.3 * f1_gb * m_mean24)
          / (0.3 * auc_rf + 0.4 * auc_xgb + 0.3 * f1_gb))) AS e0 FROM t)
SELECT series_id, ts, event_id, p_ens, lower_ci, upper_ci, w AS interval_width, threshold, prediction, confidence, trust_pct,
  CASE WHEN trust_pct >= 80 THEN 'HIGH' WHEN trust_pct >= 65 THEN 'MODERATE' WHEN trust_pct >= 50 THEN 'LOW' ELSE 'VERY LOW' END AS trust_status,
  CASE WHEN p_ens * 100 >= 60 THEN 'RAIN' WHEN p_ens * 100 >= 30 THEN 'POSSIBLE' ELSE 'CLEAR' END AS outcome3,
  CAST(CASE WHEN m_mean24 < 0.3 THEN 0 WHEN m_mean24 < 0.7 THEN 1 ELSE 2 END AS INTEGER) AS regime,
  v1_score, CASE WHEN v1_score > 0.7 THEN 'HIGH' WHEN v1_score > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS v1_confidence,
  greatest(0.0, least(1.0, CASE WHEN m_mean24 IS NOT NULL THEN 0.8 * (CASE WHEN m_mean24 > 0.7 THEN e0 * 1.2 ELSE e0 END) + 0.2 * m_mean24
       ELSE e0 END)) AS vote_p
FROM v""", ["series_id", "ts", "event_id", "prediction", "confidence", "trust_status", "outcome3", "regime", "v1_confidence"],
    ["p_ens", "lower_ci", "upper_ci", "interval_width", "threshold", "trust_pct", "v1_score", "vote_p"])


@register("forecast_grades", GRADES_SQL)
def q_grades(spark, sf_dir):
    return graded(spark, sf_dir).drop("reasons")

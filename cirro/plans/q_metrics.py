"""Driver queries for metrics, thresholds and model selection
(A10-A15, A23, A24, M21, M23, M30, J4) over the ``scored`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from cirro.functions.grades import clamp_threshold
from cirro.operators import metrics as M
from cirro.operators.joins import stack_models
from cirro.plans import views as V
from cirro.plans.registry import register, rounded

S = V.SCORED_SQL
G = ["series_id", "model"]
MODELS = ["m_now", "m_mean6", "m_mean24"]
_T = M.thresholds()
STEP = "((0.99 - 0.01) / 98)"


def sc(spark, sf_dir):
    return V.scored(spark, sf_dir)


def _fb(tp, fp, fn, b2):
    return (f"CASE WHEN (1 + {b2}) * {tp} + {b2} * {fn} + {fp} = 0 THEN 0.0 "
            f"ELSE (1 + {b2}) * {tp} / ((1 + {b2}) * {tp} + {b2} * {fn} + {fp}) END")


CONF_SQL = f"""SELECT series_id, model,
  count(*) FILTER (WHERE label = 0 AND p < 0.5) AS tn, count(*) FILTER (WHERE label = 0 AND p >= 0.5) AS fp,
  count(*) FILTER (WHERE label = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE label = 1 AND p >= 0.5) AS tp
FROM {S} AS s GROUP BY series_id, model"""


@register("confusion", CONF_SQL)
def q_confusion(spark, sf_dir):
    return M.confusion(sc(spark, sf_dir), G, thr=0.5)


METRICS_SQL = rounded(f"""
SELECT *, CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn) END AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
  {_fb('tp', 'fp', 'fn', 1.0)} AS f1, {_fb('tp', 'fp', 'fn', 4.0)} AS fbeta
FROM ({CONF_SQL}) AS c""", ["series_id", "model", "tn", "fp", "fn", "tp"],
    ["accuracy", "precision", "recall", "f1", "fbeta"])


@register("class_metrics", METRICS_SQL)
def q_class_metrics(spark, sf_dir):
    return M.class_metrics(M.confusion(sc(spark, sf_dir), G, thr=0.5), beta=2.0)


_COUNTS = f"""(SELECT series_id, model, p, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg
  FROM {S} AS s WHERE label IS NOT NULL AND p IS NOT NULL GROUP BY series_id, model, p)"""
AUC_SQL = rounded(f"""
WITH c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY series_id, model ORDER BY p
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {_COUNTS} AS d)
SELECT series_id, model, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
  THEN sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc FROM c GROUP BY series_id, model""",
    G, ["auc"])


@register("auc_roc", AUC_SQL)
def q_auc(spark, sf_dir):
    return M.auc_roc(sc(spark, sf_dir), G)


AP_SQL = rounded(f"""
WITH c AS (SELECT *, sum(pos) OVER (PARTITION BY series_id, model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                  sum(neg) OVER (PARTITION BY series_id, model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
                  sum(pos) OVER (PARTITION BY series_id, model) AS npos FROM {_COUNTS} AS d)
SELECT series_id, model, CASE WHEN max(npos) > 0 THEN sum(pos / npos * tp / (tp + fp)) END AS average_precision
FROM c GROUP BY series_id, model""", G, ["average_precision"])


@register("average_precision", AP_SQL)
def q_ap(spark, sf_dir):
    return M.average_precision(sc(spark, sf_dir), G)


_GRID_SQL = f"""(SELECT i AS j, CASE WHEN i = 98 THEN 0.99 ELSE i * {STEP} + 0.01 END AS t FROM range(99) AS r(i))"""
_SWEEP = f"""(SELECT s.series_id, s.model, g.j, g.t,
   count(*) FILTER (WHERE s.label = 0 AND s.p < g.t) AS tn, count(*) FILTER (WHERE s.label = 0 AND s.p >= g.t) AS fp,
   count(*) FILTER (WHERE s.label = 1 AND s.p < g.t) AS fn, count(*) FILTER (WHERE s.label = 1 AND s.p >= g.t) AS tp
  FROM {S} AS s, {_GRID_SQL} AS g GROUP BY s.series_id, s.model, g.j, g.t)"""
BEST_SQL_INNER = f"""
SELECT series_id, model, CASE WHEN max(score) > 0 THEN arg_max(t, (score, -t)) ELSE 0.5 END AS threshold,
  CASE WHEN max(score) > 0 THEN max(score) ELSE 0.0 END AS score
FROM (SELECT *, {_fb('tp', 'fp', 'fn', 4.0)} AS score FROM {_SWEEP} AS w) AS x GROUP BY series_id, model"""
BEST_SQL = rounded(BEST_SQL_INNER, G, ["threshold", "score"])


@register("best_threshold", BEST_SQL)
def q_best(spark, sf_dir):
    return M.best_threshold(sc(spark, sf_dir), G)


CLAMP_SQL = rounded(f"""
SELECT series_id, model, threshold AS tuned,
  CASE WHEN threshold > 0.4 THEN 0.35 WHEN threshold < 0.2 THEN 0.25 ELSE threshold END AS threshold
FROM ({BEST_SQL_INNER}) AS b""", G, ["tuned", "threshold"])


@register("clamp_threshold", CLAMP_SQL)
def q_clamp(spark, sf_dir):
    b = M.best_threshold(sc(spark, sf_dir), G)
    return b.select(*G, F.col("threshold").alias("tuned"), clamp_threshold(F.col("threshold")).alias("threshold"))


CQ_SQL = rounded(f"""SELECT series_id, model, quantile_cont(abs(p - label), 0.8) AS conformal_q
FROM {S} AS s GROUP BY series_id, model""", G, ["conformal_q"])


@register("conformal_quantile", CQ_SQL)
def q_cq(spark, sf_dir):
    return M.conformal_quantile(sc(spark, sf_dir), G)


PERIOD_INNER = f"""
WITH b AS ({BEST_SQL_INNER}),
r AS (SELECT s.series_id, s.model, s.label, s.p, b.threshold,
        row_number() OVER (PARTITION BY s.series_id, s.model ORDER BY s.ts, s.event_id) - 1 AS r0,
        count(*) OVER (PARTITION BY s.series_id, s.model) AS n
      FROM {S} AS s JOIN b ON s.series_id = b.series_id AND s.model = b.model),
q AS (SELECT *, CAST(least(floor(r0 / greatest(n // 3, 1)), 2) AS INTEGER) AS period FROM r),
per AS (SELECT series_id, model, period,
          count(*) FILTER (WHERE label = 1 AND p >= threshold) AS tp, count(*) FILTER (WHERE label = 0 AND p >= threshold) AS fp,
          count(*) FILTER (WHERE label = 1 AND p < threshold) AS fn, count(DISTINCT label) AS classes
        FROM q GROUP BY series_id, model, period),
f AS (SELECT series_id, model, {_fb('tp', 'fp', 'fn', 4.0)} AS f FROM per WHERE classes >= 2)
SELECT series_id, model, count(*) AS n_periods, min(f) AS f_min, avg(f) AS f_avg, stddev_pop(f) AS f_std, max(f) AS f_max
FROM f GROUP BY series_id, model"""
PERIOD_SQL = rounded(PERIOD_INNER, ["series_id", "model", "n_periods"], ["f_min", "f_avg", "f_std", "f_max"])


def _periods(spark, sf_dir):
    s = sc(spark, sf_dir)
    thr = M.best_threshold(s, G)
    return M.period_scores(s, G, ["ts", "event_id"], thr), thr, s


@register("period_scores", PERIOD_SQL)
def q_periods(spark, sf_dir):
    return _periods(spark, sf_dir)[0]


SELECT_SQL = rounded(f"""
WITH p AS ({PERIOD_INNER}), b AS ({BEST_SQL_INNER}),
v AS (SELECT series_id, count(DISTINCT label) AS classes FROM {S} AS s GROUP BY series_id),
m AS (SELECT b.series_id, b.model, b.threshold, coalesce(p.f_min, b.score) AS model_score, v.classes >= 2 AS has_both
      FROM b LEFT JOIN p ON b.series_id = p.series_id AND b.model = p.model JOIN v ON v.series_id = b.series_id)
SELECT series_id, model, model_score, has_both,
  CASE WHEN NOT has_both THEN true WHEN sum(CAST(model_score >= 0.5 AS INTEGER)) OVER (PARTITION BY series_id) = 0 THEN true
       ELSE model_score >= 0.5 END AS kept FROM m""", ["series_id", "model", "has_both", "kept"], ["model_score"])


def _model_scores(spark, sf_dir):
    per, thr, s = _periods(spark, sf_dir)
    classes = s.groupBy("series_id").agg((F.countDistinct("label") >= 2).alias("has_both"))
    m = (thr.join(per, G, "left").join(classes, "series_id")
         .select(*G, "threshold", F.coalesce("f_min", "score").alias("model_score"), "has_both"))
    return m, s


@register("select_models", SELECT_SQL)
def q_select(spark, sf_dir):
    m, _ = _model_scores(spark, sf_dir)
    return M.select_models(m, ["series_id"]).select(*G, "model_score", "has_both", "kept")


STATUS_SQL = rounded(f"""
WITH p AS ({PERIOD_INNER}), b AS ({BEST_SQL_INNER}),
l AS (SELECT series_id, model, arg_max(p, (ts, event_id)) AS p_last FROM {S} AS s GROUP BY series_id, model),
m AS (SELECT b.series_id, b.model, b.threshold, coalesce(p.f_min, b.score) AS model_score
      FROM b LEFT JOIN p ON b.series_id = p.series_id AND b.model = p.model)
SELECT m.series_id, m.model, l.p_last, m.threshold, CASE WHEN l.p_last >= m.threshold THEN 'RAIN' ELSE 'NO RAIN' END AS outcome,
  m.model_score, CASE WHEN m.model_score >= 0.6 THEN 'Stable' WHEN m.model_score >= 0.5 THEN 'Marginal' ELSE 'Excluded' END AS status
FROM m JOIN l ON m.series_id = l.series_id AND m.model = l.model""",
    ["series_id", "model", "outcome", "status"], ["p_last", "threshold", "model_score"])


@register("model_status_table", STATUS_SQL)
def q_status(spark, sf_dir):
    m, s = _model_scores(spark, sf_dir)
    last = s.groupBy(*G).agg(F.max_by("p", F.struct("ts", "event_id")).alias("p_last"))
    j = m.join(last, G)
    return j.select(*G, "p_last", "threshold",
                    F.when(F.col("p_last") >= F.col("threshold"), "RAIN").otherwise("NO RAIN").alias("outcome"),
                    "model_score", M.model_status(F.col("model_score")).alias("status"))


STACK_SQL = rounded(f"""
SELECT series_id, ts, event_id, max(p) FILTER (WHERE model = 'm_now') AS m_now,
  max(p) FILTER (WHERE model = 'm_mean6') AS m_mean6, max(p) FILTER (WHERE model = 'm_mean24') AS m_mean24
FROM {S} AS s GROUP BY series_id, ts, event_id""", ["series_id", "ts", "event_id"], MODELS)


@register("stack_models", STACK_SQL)
def q_stack(spark, sf_dir):
    return stack_models(sc(spark, sf_dir), ["series_id", "ts", "event_id"], MODELS)


_WIDE = (f"(SELECT series_id, ts, event_id, max(p) FILTER (WHERE model = 'm_now') AS m_now, "
         f"max(p) FILTER (WHERE model = 'm_mean6') AS m_mean6, max(p) FILTER (WHERE model = 'm_mean24') AS m_mean24 "
         f"FROM {S} AS s GROUP BY series_id, ts, event_id)")
SIM_SQL = rounded(" UNION ALL ".join(
    f"SELECT series_id, '{a}' AS model_i, '{b}' AS model_j, "
    f"coalesce(CASE WHEN isnan(corr({a}, {b})) THEN 0 ELSE corr({a}, {b}) END, 0) AS similarity "
    f"FROM {_WIDE} AS w GROUP BY series_id"
    for i, a in enumerate(MODELS) for b in MODELS[i + 1:]), ["series_id", "model_i", "model_j"], ["similarity"])


@register("model_similarity", SIM_SQL)
def q_similarity(spark, sf_dir):
    from cirro.operators.aggregates import pair_stats_long
    wide = stack_models(sc(spark, sf_dir), ["series_id", "ts", "event_id"], MODELS)
    long = pair_stats_long(wide, ["series_id"], MODELS, "corr")
    order = {m: i for i, m in enumerate(MODELS)}
    idx = F.create_map(*[x for m, i in order.items() for x in (F.lit(m), F.lit(i))])
    return (long.filter(idx[F.col("var_i")] < idx[F.col("var_j")])
            .select("series_id", F.col("var_i").alias("model_i"), F.col("var_j").alias("model_j"),
                    F.col("value").alias("similarity")))


_ = _T

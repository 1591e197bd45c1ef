"""Classification metrics as grouped Spark jobs.

Rank-based metrics (AUC, average precision) and the threshold sweep need
running sums over the scores in order.  A window ordered by score over a
whole group would put a hot group into one task, so ``value_prefix``
computes exact prefix sums with the same trick as the row layout: rows
are first reduced to one row per distinct score, scores are bucketed by
value, bucket totals get offsets from a running sum over the small bucket
table, and the final running sum runs per (group, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirro.functions.grades import clamp_threshold
from cirro.functions.stats import safe_div
from cirro.operators.quantiles import exact_quantiles


def thresholds(start: float = 0.01, stop: float = 0.99, num: int = 99) -> list[float]:
    """The sweep grid, computed like ``numpy.linspace`` (i*step + start,
    last point exactly ``stop``)."""
    step = (stop - start) / (num - 1)
    out = [i * step + start for i in range(num)]
    out[-1] = stop
    return out


def _pred(p: Column, thr) -> Column:
    t = thr if isinstance(thr, Column) else F.lit(float(thr))
    return (p >= t).cast("int")


def confusion(df: DataFrame, keys: Sequence[str], label: str = "label", p: str = "p",
              thr=0.5) -> DataFrame:
    """A10: TN, FP, FN, TP per group for prediction ``p >= thr``."""
    y, yh = F.col(label), _pred(F.col(p), thr)
    return df.groupBy(*keys).agg(
        F.count_if((y == 0) & (yh == 0)).alias("tn"), F.count_if((y == 0) & (yh == 1)).alias("fp"),
        F.count_if((y == 1) & (yh == 0)).alias("fn"), F.count_if((y == 1) & (yh == 1)).alias("tp"))


def fbeta_col(tp, fp, fn, beta: float) -> Column:
    """F-beta with sklearn's zero_division=0."""
    b2 = beta * beta
    return safe_div((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)


def class_metrics(conf: DataFrame, beta: float = 2.0) -> DataFrame:
    """Accuracy, precision, recall, F1, F-beta; 0/0 -> 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return conf.select(
        "*",
        safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        safe_div(tp, tp + fp).alias("precision"),
        safe_div(tp, tp + fn).alias("recall"),
        fbeta_col(tp, fp, fn, 1.0).alias("f1"),
        fbeta_col(tp, fp, fn, beta).alias("fbeta"))


def value_prefix(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str],
                 lo: float = 0.0, hi: float = 1.0, n_buckets: int = 1024) -> DataFrame:
    """For a table with one row per (keys, value), add ``<s>_below``: the
    sum of ``s`` over rows of the group with a strictly smaller value."""
    keys = list(keys)
    b = F.least(F.greatest(F.floor((F.col(value) - lo) / (hi - lo) * n_buckets), F.lit(0)),
                F.lit(n_buckets - 1)).cast("int")
    d = df.withColumn("_vb", b)
    tot = d.groupBy(*keys, "_vb").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    wb = Window.partitionBy(*keys).orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*keys, "_vb", *[F.coalesce(F.sum(f"_t_{s}").over(wb), F.lit(0)).alias(f"_o_{s}")
                                      for s in sums])
    j = d.join(offs, keys + ["_vb"], "left")
    wi = Window.partitionBy(*keys, "_vb").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return j.select(*df.columns, *[(F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(wi), F.lit(0)))
                                   .alias(f"{s}_below") for s in sums])


def _score_counts(df: DataFrame, keys, label, p) -> DataFrame:
    return (df.filter(F.col(label).isNotNull() & F.col(p).isNotNull())
            .groupBy(*keys, F.col(p).alias("_p"))
            .agg(F.sum(F.col(label).cast("long")).alias("pos"),
                 F.sum((1 - F.col(label)).cast("long")).alias("neg")))


def auc_roc(df: DataFrame, keys: Sequence[str], label: str = "label", p: str = "p") -> DataFrame:
    """Area under the ROC curve, ties counted one half; NULL when a
    group has one class."""
    c = value_prefix(_score_counts(df, keys, label, p), keys, "_p", ["neg"])
    g = c.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("_a"),
        F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    return g.select(*keys, F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                                  F.col("_a") / (F.col("_P") * F.col("_N"))).alias("auc"))


def average_precision(df: DataFrame, keys: Sequence[str], label: str = "label", p: str = "p") -> DataFrame:
    """Sum over distinct scores (descending) of recall step x precision."""
    c = value_prefix(_score_counts(df, keys, label, p), keys, "_p", ["pos", "neg"])
    tot = c.groupBy(*keys).agg(F.sum("pos").alias("_tot_pos"), F.sum("neg").alias("_tot_neg"))
    j = c.join(tot, list(keys))
    tp = F.col("_tot_pos") - F.col("pos_below")       # rows with score >= this score
    fp = F.col("_tot_neg") - F.col("neg_below")
    term = F.when(F.col("_tot_pos") > 0, F.col("pos") / F.col("_tot_pos") * tp / (tp + fp))
    g = j.groupBy(*keys).agg(F.sum(term).alias("_ap"),
                             F.max("_tot_pos").alias("_npos"))
    return g.select(*keys, F.when(F.col("_npos") > 0, F.col("_ap")).alias("average_precision"))


_METRIC_NAMES = ("f2", "f1", "accuracy", "recall", "precision")


def _metric_col(metric: str, tn, fp, fn, tp, beta: float) -> Column:
    if metric == "f2":
        return fbeta_col(tp, fp, fn, beta)
    if metric == "f1":
        return fbeta_col(tp, fp, fn, 1.0)
    if metric == "accuracy":
        return safe_div(tp + tn, tp + tn + fp + fn)
    if metric == "recall":
        return safe_div(tp, tp + fn)
    if metric == "precision":
        return safe_div(tp, tp + fp)
    raise ValueError(f"unknown metric {metric}")


def threshold_sweep(df: DataFrame, keys: Sequence[str], label: str = "label", p: str = "p",
                    grid: Sequence[float] | None = None) -> DataFrame:
    """Confusion counts at every grid threshold, from a histogram.

    Each distinct score gets ``m`` = number of grid thresholds <= score;
    per (group, m) the class counts form a histogram of at most
    len(grid)+1 rows, and suffix sums over it give TP/FP at each
    threshold.  Output: one row per (group, threshold index).
    """
    keys = list(keys)
    grid = list(grid or thresholds())
    arr = F.array(*[F.lit(float(t)) for t in grid])
    sc = _score_counts(df, keys, label, p)
    hist = (sc.withColumn("_m", F.size(F.filter(arr, lambda t: t <= F.col("_p"))))
            .groupBy(*keys, "_m").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    tot = hist.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # one row per (group, threshold index j); rows with _m > j predict 1 at t_j
    idx = tot.select(*keys, "P", "N", F.posexplode(arr).alias("j", "t"))
    h = hist.withColumnRenamed("_m", "_hm")
    j = idx.join(h, keys, "left")
    above = F.when(F.col("_hm") > F.col("j"), 1).otherwise(0)
    g = j.groupBy(*keys, "j", "t", "P", "N").agg(
        F.sum(above * F.col("pos")).alias("tp"), F.sum(above * F.col("neg")).alias("fp"))
    return g.select(*keys, "j", "t", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
                    (F.col("P") - F.col("tp")).cast("long").alias("fn"),
                    (F.col("N") - F.col("fp")).cast("long").alias("tn"))


def best_threshold(df: DataFrame, keys: Sequence[str], label: str = "label", p: str = "p",
                   metric: str = "f2", beta: float = 2.0) -> DataFrame:
    """Threshold maximising ``metric`` over the 99-point grid; strict
    improvement, so the lowest threshold wins ties; all scores 0 -> 0.5."""
    sw = threshold_sweep(df, keys, label, p)
    s = sw.withColumn("score", _metric_col(metric, F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"), beta))
    g = s.groupBy(*keys).agg(F.max_by(F.struct("t", "score"),
                                      F.struct(F.col("score"), -F.col("t"))).alias("_b"))
    return g.select(*keys,
                    F.when(F.col("_b.score") > 0, F.col("_b.t")).otherwise(F.lit(0.5)).alias("threshold"),
                    F.when(F.col("_b.score") > 0, F.col("_b.score")).otherwise(F.lit(0.0)).alias("score"))


def conformal_quantile(df: DataFrame, keys: Sequence[str], label: str = "label", p: str = "p",
                       q: float = 0.8) -> DataFrame:
    """Linear-interpolated quantile of |p - y| (numpy.quantile)."""
    e = df.select(*keys, F.abs(F.col(p) - F.col(label)).alias("_err"))
    return exact_quantiles(e, keys, "_err", [q], ["conformal_q"])


def period_scores(df: DataFrame, keys: Sequence[str], order: Sequence[str], thr: DataFrame,
                  label: str = "label", p: str = "p", beta: float = 2.0, k: int = 3) -> DataFrame:
    """F-beta on each consecutive third of the rows (by ``order``) at
    the group's threshold (``thr``: keys + threshold); thirds with one
    class are skipped.  Period size max(1, n // 3); an empty last third
    merges into the second, as in the reference.  Returns per group the
    per-period scores and min / avg / population std / max."""
    from cirro.plans.layout import with_positions
    from cirro.plans.series import POS, SeriesSpec
    keys = list(keys)
    spec = SeriesSpec(keys=tuple(keys), order=order[0], tiebreak=tuple(order[1:]))
    pos = with_positions(df.select(*keys, *order, label, p), spec)
    n = pos.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = pos.join(n, keys).join(thr.select(*keys, "threshold"), keys)
    ps = F.greatest(F.floor(F.col("_n") / k), F.lit(1))
    d = d.withColumn("period", F.least(F.floor((F.col(POS) - 1) / ps), F.lit(k - 1)).cast("int"))
    yh = _pred(F.col(p), F.col("threshold"))
    y = F.col(label)
    per = d.groupBy(*keys, "period").agg(
        F.count_if((y == 1) & (yh == 1)).alias("tp"), F.count_if((y == 0) & (yh == 1)).alias("fp"),
        F.count_if((y == 1) & (yh == 0)).alias("fn"), F.countDistinct(label).alias("_classes"))
    per = per.filter(F.col("_classes") >= 2).withColumn(
        "f", fbeta_col(F.col("tp"), F.col("fp"), F.col("fn"), beta))
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.min("f").alias("f_min"), F.avg("f").alias("f_avg"),
        F.stddev_pop("f").alias("f_std"), F.max("f").alias("f_max"))


def select_models(scores: DataFrame, group: Sequence[str], model: str = "model",
                  score: str = "model_score", min_score: float = 0.5,
                  has_both: str = "has_both") -> DataFrame:
    """Keep models whose (minimum-period) score >= ``min_score``; keep
    all when none pass or when validation has one class."""
    group = list(group)
    w = Window.partitionBy(*group)
    passes = F.col(score) >= min_score
    n_pass = F.sum(passes.cast("int")).over(w)
    keep = F.when(~F.col(has_both), True).when(n_pass == 0, True).otherwise(passes)
    return scores.withColumn("kept", keep)


def model_status(score: Column) -> Column:
    """M30 status edges (ours; the reference leaves them unspecified)."""
    return F.when(score >= 0.6, "Stable").when(score >= 0.5, "Marginal").otherwise("Excluded")


def clamp_threshold_col(t: Column) -> Column:
    return clamp_threshold(t)

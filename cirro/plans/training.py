"""The modelling plan: features -> regimes -> label -> split -> selection ->
scaling -> oversampling -> search -> calibration -> model choice -> stack ->

Learners are fitted over all series together; splits, scaling, regimes,
thresholds, period scores and conformal quantiles are per series or per
model.  Whatever is fitted sees training rows only: regimes (filtered, without
later rows), fill means, components, feature choice, scaling, and in each fold the
synthetic rows.  All folds are sets of one training table (``operators.programs``),
so the search is one job per kind of learner, not one per fit.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from cirro.functions import grades as GR
from cirro.operators import metrics as M
from cirro.operators import models as ML
from cirro.operators import programs as P
from cirro.operators import search as S
from cirro.operators.hidden_states import hidden_states
from cirro.operators.sampling import balanced_subset, oversample_minority
from cirro.operators.select import feature_columns
from cirro.operators.selection import mutual_information
from cirro.operators.splits import chronological_split, time_folds
from cirro.operators.windows import future_label
from cirro.plans import views as V
from cirro.plans.features import engineer_features
from cirro.plans.layout import with_positions
from cirro.plans.series import POS, SeriesSpec
from cirro.session import cut_lineage

SPEC = SeriesSpec(keys=("series_id",), order="ts")
HORIZON = 6
RAIN_THR = 3.0           # label: precipitation summed over the next 6 rows > 3.0
KINDS = ["rf", "xgb", "lgb", "gb", "lr", "svm", "et", "mlp"]
REGIME_COLS = ["pressure", "temperature", "humidity"]
ROW = "row_key"


@dataclass
class Trained:
    data: DataFrame                       # prepared rows: keys, ts, split, label, chosen and scaled features
    feature_cols: list
    models: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)
    search_scores: dict = field(default_factory=dict)
    calib: dict = field(default_factory=dict)            # (slope, intercept) of a learner's score, or None
    thresholds: dict = field(default_factory=dict)
    kept: list = field(default_factory=list)
    stack: object = None
    ens_threshold: float = 0.5
    ens_q: float = 0.0


def chosen_features(train: DataFrame, cols: list, label: str = "label") -> list:
    """T1 on the training rows of all series: the best 30 %, 50 to 150, by mutual information (names break ties)."""
    mi = {r["feature"]: r["mi"] for r in mutual_information(train, [], cols, label).collect()}        # one row per feature
    n = min(150, max(50, int(0.3 * len(cols))))
    return sorted(cols, key=lambda c: (-mi.get(c, 0.0), c))[:n]


def prepare(spark, sf_dir, pca_k: int = 5) -> tuple[DataFrame, list]:
    wx = V.ev_weather(spark, sf_dir)
    lab = future_label(wx, SPEC, "precipitation", HORIZON, RAIN_THR, name="label")
    # Rows without a full horizon have no label: they are scored, never fitted or measured.
    sp = chronological_split(lab.filter(F.col("label").isNotNull()), SPEC)
    sp = sp.unionByName(lab.filter(F.col("label").isNull()).withColumn("split", F.lit("score")))
    sp = cut_lineage(sp.withColumn("is_train", F.col("split") == "train"))
    regimes = hidden_states(sp, SPEC, REGIME_COLS, 3, fit_mask="is_train", smooth=False)
    sp = cut_lineage(regimes.drop("regime_0", "regime_1", "regime_2", "state", "fallback"))
    feats = cut_lineage(engineer_features(sp, SPEC, pca_k=pca_k, fit_mask="is_train"))
    cols = [c for c in feature_columns(feats, "label", exclude=("precipitation",)) if c not in ("is_train",)]
    cols = chosen_features(feats.filter("is_train"), cols)
    scaled = ML.robust_scale(feats.select("series_id", "ts", "split", "is_train", "label", *cols), ["series_id"], cols, "is_train")
    # validation parts for the stack (Q7): the first one fits, the second one
    # measures the conformal quantile
    pos = with_positions(scaled, SPEC)
    n = pos.groupBy("series_id").agg(F.count("label").alias("_n"))
    pos = pos.join(n, "series_id").withColumn(
        "val_part", F.when(F.col("split") != "validation", F.lit(None))
        .when(F.col(POS) <= F.floor(F.col("_n") * 0.7), "a").otherwise("b")).drop("_n")
    key = F.concat_ws("|", "series_id", F.col("ts").cast("string")).alias(ROW)
    return cut_lineage(pos.select("series_id", "ts", POS, key, "split", "val_part", "label",
                                  *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])), cols


def training_rows(train: DataFrame, cols: list, k_folds: int) -> tuple[DataFrame, list]:
    """(rows with one role column per fold and one for all; role columns).  Each set gets synthetic minority
    rows (M11) made of its own training rows."""
    roles = [f"_r{i}" for i in range(k_folds)] + ["_all"]
    folds = time_folds(train.select("series_id", "ts", ROW), SPEC, k_folds)
    by_row = folds.groupBy(ROW).agg(*[F.max(F.when(F.col("fold") == i, F.when(F.col("role") == "train", P.TRAIN).otherwise(P.TEST))).alias(roles[i]) for i in range(k_folds)])
    rows = cut_lineage(train.select(ROW, "label", *cols).join(by_row, ROW, "left").withColumn("_all", F.lit(P.TRAIN)))

    def synthetic(role):
        own = rows.filter(F.col(role) == P.TRAIN).select(ROW, "label", *cols)
        made = oversample_minority(own, ROW, cols, "label").withColumn(ROW, F.concat(F.lit(f"{role}:"), "synthetic_id"))
        return cut_lineage(made.select(ROW, "label", *cols, *[F.lit(P.TRAIN if r == role else P.NONE).alias(r) for r in roles]))

    with ThreadPool(4) as pool:
        for made in pool.map(inheritable_thread_target(train.sparkSession)(synthetic), roles):
            rows = rows.unionByName(made)
    return rows, roles


def calibrated(calib, p: Column) -> Column:
    """The logistic curve of a learner's raw score; the score itself where none was fitted."""
    return p if calib is None else 1 / (1 + F.exp(-(F.lit(calib[0]) * p + F.lit(calib[1]))))


def train(spark, sf_dir, kinds=KINDS, n_iter: int = 10, k_folds: int = 3) -> Trained:
    """Defaults follow the reference's search: 10 random settings scored
    over 3 expanding time folds per learner."""
    data, cols = prepare(spark, sf_dir)
    t = Trained(data=data, feature_cols=cols)
    rows, roles = training_rows(data.filter(F.col("split") == "train"), cols, k_folds)
    table = P.training_table(rows, cols, "label", ROW, roles)
    found = S.search(table, kinds, list(range(k_folds)), k_folds, n_iter)
    for kind, (model, params, score) in found.items():
        t.models[kind], t.params[kind], t.search_scores[kind] = model, params, score
    val = cut_lineage(P.predictions(data.filter(F.col("split") == "validation"), cols, t.models).drop(*cols))
    # The first part, brought to the share of positives in training (T4), fits calibration, thresholds and stack; the
    # second one, where the conformal quantile is measured, stays held out.
    part = val.filter(F.col("val_part") == "a")
    rate = data.filter(F.col("split") == "train").agg(F.avg("label")).first()[0]
    tune = cut_lineage(balanced_subset(part, float(rate or 0.0), ["series_id", "ts"]))
    has_both = tune.select("label").distinct().count() >= 2

    def platt(kind):
        fitted = ML.platt_calibrate(tune.select("label", F.col(kind).alias("p"))) if has_both else None
        return None if fitted is None else (float(fitted.stages[-1].coefficients[0]), float(fitted.stages[-1].intercept))

    with ThreadPool(4) as pool:
        t.calib = dict(zip(kinds, pool.map(inheritable_thread_target(spark)(platt), kinds)))
    curves = [calibrated(t.calib[k], F.col(k)).alias(k) for k in kinds]
    keys = ["series_id", "ts", POS, "val_part", "label"]
    tune, val = cut_lineage(tune.select(*keys, *curves)), cut_lineage(val.select(*keys, *curves))
    # per-model threshold and period stability
    long = tune.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("model"), F.col(k).alias("p")) for k in kinds])))
    thr = cut_lineage(M.best_threshold(long, ["model"]))
    per = M.period_scores(long, ["model"], ["ts", "series_id"], thr)
    ms = (thr.join(per, "model", "left")
          .select("model", "threshold", F.coalesce("f_min", "score").alias("model_score"))
          .withColumn("has_both", F.lit(has_both)).withColumn("_g", F.lit(1)))
    sel = M.select_models(ms, ["_g"]).collect()          # one row per learner
    t.thresholds = {r["model"]: r["threshold"] for r in sel}
    t.kept = [k for k in kinds if any(r["model"] == k and r["kept"] for r in sel)]
    # stack (M22): a random forest on the kept learners' calibrated probabilities
    if has_both:
        meta = P.training_table(tune.select("label", *t.kept, F.concat_ws("|", "series_id", F.col("ts").cast("string")).alias(ROW), F.lit(P.TRAIN).alias("_all")),
                                t.kept, "label", ROW, ["_all"])
        t.stack = S.fit_many(meta, [("rf", 0, {"trees": 200, "depth": 10})])[0]
    ens = cut_lineage(stack_score(t, val))
    bt = M.best_threshold(ens.filter(F.col("val_part") == "a").withColumn("_g", F.lit(1)), ["_g"], p="p_ens").first()
    t.ens_threshold = _clamp(float(bt["threshold"]))
    qb = ens.filter(F.col("val_part") == "b")
    if qb.limit(1).count() == 0:
        qb = ens
    q = M.conformal_quantile(qb.withColumn("_g", F.lit(1)), ["_g"], p="p_ens").first()
    t.ens_q = float(q["conformal_q"]) if q and q["conformal_q"] is not None else 0.0
    return t


def _clamp(x: float) -> float:
    return 0.35 if x > 0.4 else 0.25 if x < 0.2 else float(x)


def stack_score(t: Trained, wide: DataFrame) -> DataFrame:
    if t.stack is None:
        # one class in the stack's rows: mean of the kept models (M20 spirit)
        mean = sum((F.col(m) for m in t.kept), F.lit(0.0)) / max(len(t.kept), 1)
        return wide.withColumn("p_ens", mean)
    return P.predictions(wide, t.kept, {"p_ens": t.stack})


def score_rows(t: Trained, rows: DataFrame) -> DataFrame:
    """All kept models -> calibration -> stack on ``rows`` (prepared rows)."""
    raw = P.predictions(rows, t.feature_cols, {k: t.models[k] for k in t.kept})
    wide = raw.select("series_id", "ts", POS, "label", *[calibrated(t.calib.get(k), F.col(k)).alias(k) for k in t.kept])
    return stack_score(t, wide)


def test_metrics(t: Trained) -> DataFrame:
    """Per learner and for the ensemble: test accuracy, precision, recall,
    F1, F2, AUC, the tuned threshold, whether kept, and the share of
    positives (the constant-prediction baseline)."""
    spark = t.data.sparkSession
    test = t.data.filter(F.col("split") == "test")
    raw = P.predictions(test, t.feature_cols, t.models)
    wide = raw.select("series_id", "ts", "label", *[calibrated(t.calib.get(k), F.col(k)).alias(k) for k in t.models])
    wide = cut_lineage(stack_score(t, wide))
    rows = wide.select("label", F.inline(F.array(*[
        F.struct(F.col(k).alias("p"), F.lit(k).alias("model"), F.lit(float(t.thresholds.get(k, 0.5))).alias("threshold")) for k in t.models],
        F.struct(F.col("p_ens").alias("p"), F.lit("ensemble").alias("model"), F.lit(float(t.ens_threshold)).alias("threshold")))))
    conf = M.confusion(rows, ["model", "threshold"], thr=F.col("threshold"))
    met = M.class_metrics(conf, beta=2.0)
    auc = M.auc_roc(rows, ["model"])
    base = rows.groupBy("model").agg(F.avg("label").alias("positive_rate"))
    kept = spark.createDataFrame([(k, k in t.kept) for k in t.models] + [("ensemble", True)], "model string, kept boolean")
    return (met.join(auc, "model").join(base, "model").join(kept, "model")
            .withColumnRenamed("fbeta", "f2"))


def score_latest(t: Trained, quality: DataFrame | None = None, volatility: DataFrame | None = None) -> DataFrame:
    """The latest row of every series -> models -> calibration ->
    stack -> interval [p-q, p+q] -> outcome, confidence grade, trust.

    ``quality`` (series_id, quality) and ``volatility`` (series_id, ts,
    volatile_prob) enter the trust points; where absent, quality counts as
    1 and no volatility is held against the forecast."""
    d = t.data
    last = d.groupBy("series_id").agg(F.max(POS).alias("_last"))
    latest = d.join(last, "series_id").filter(F.col(POS) == F.col("_last")).drop("_last")
    s = score_rows(t, latest)
    lo, hi, width = GR.conformal_interval(F.col("p_ens"), F.lit(t.ens_q))
    conf = GR.confidence_grade(width)
    outcome = F.when(F.col("p_ens") >= t.ens_threshold, "RAIN").otherwise("NO RAIN")
    prng = F.array_max(F.array(*[F.col(m) for m in t.kept])) - F.array_min(F.array(*[F.col(m) for m in t.kept]))
    qcol = F.col("quality") if quality is not None else F.lit(1.0)
    if quality is not None:
        s = s.join(quality, "series_id", "left")
    if volatility is not None:
        s = s.join(volatility, ["series_id", "ts"], "left")
    vol = F.col("volatile_prob") if volatility is not None else F.lit(0.0)
    trust = GR.trust_score(qcol, width, prng, F.lit(len(t.kept)), conf, outcome, F.col("p_ens"), vol)
    return s.select("series_id", "ts", F.col("p_ens").alias("probability"), lo.alias("lower_ci"),
                    hi.alias("upper_ci"), width.alias("interval_width"), outcome.alias("prediction"),
                    conf.alias("confidence"), trust["trust_pct"].alias("trust_pct"),
                    trust["trust_status"].alias("trust_status"),
                    *[F.col(m).alias(f"{m}_pred") for m in t.kept])

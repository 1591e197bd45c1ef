"""Preparation and model operators on MLlib.

Models are trained once over all series together (a pooled, distributed
MLlib fit); per-series quantities (splits, thresholds, quantiles) stay
per series.  Only model parameters (PCA loadings, coefficients, trees)
ever reach the driver.

The reference's learners are scikit-learn/XGBoost/LightGBM; the MLlib
mapping is: random forest -> ``RandomForestClassifier``; gradient
boosting (three libraries) -> ``GBTClassifier``; logistic regression ->
``LogisticRegression``; RBF SVM -> ``LinearSVC`` (linear kernel) with
Platt scaling; extra trees -> ``RandomForestClassifier(bootstrap=False,
featureSubsetStrategy='sqrt')`` (split points are not randomised); MLP ->
``MultilayerPerceptronClassifier`` (no early stopping).
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
    RandomForestClassifier)
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from cirro.operators.metrics import confusion, fbeta_col
from cirro.operators.quantiles import exact_quantiles
from cirro.plans.layout import join_by_keys

FEATURES = "features"


# --- M4 / M5 / S15 --------------------------------------------------------------------
def _pca_pipeline(df: DataFrame, cols: Sequence[str], k: int, with_std: bool, fit_mask: str | None):
    va = VectorAssembler(inputCols=list(cols), outputCol="_fv", handleInvalid="keep")
    sc = StandardScaler(withMean=True, withStd=with_std, inputCol="_fv", outputCol="_fc")
    pca = PCA(k=min(k, len(cols)), inputCol="_fc", outputCol="_pc")
    fit_df = df.filter(F.col(fit_mask)) if fit_mask else df
    model = Pipeline(stages=[va, sc, pca]).fit(fit_df)
    pcm = model.stages[-1]
    mat = pcm.pc.toArray()                      # n_features x k (model parameters)
    signs = []
    for j in range(mat.shape[1]):
        col = mat[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    return model, signs, mat


def pca_features(df: DataFrame, cols: Sequence[str], k: int = 5, fit_mask: str | None = None,
                 prefix: str = "pca_") -> DataFrame:
    """M4: k principal components of the *unscaled* (centred) features,
    appended as ``pca_1..k``.  Sign fixed: largest loading positive."""
    model, signs, _ = _pca_pipeline(df, cols, k, False, fit_mask)
    out = model.transform(df)
    arr = vector_to_array("_pc")
    return out.select(*df.columns, *[(arr[j] * signs[j]).alias(f"{prefix}{j + 1}") for j in range(len(signs))])


def pca_report(df: DataFrame, cols: Sequence[str], k: int = 5, n_loadings: int | None = None):
    """M5: PCA of standardised variables -> (component scores DataFrame,
    report DataFrame: component, explained, cumulative, PC1 loadings of
    all columns, or of the first ``n_loadings``)."""
    spark = df.sparkSession
    model, signs, mat = _pca_pipeline(df, cols, k, True, None)
    ev = list(model.stages[-1].explainedVariance.toArray())
    cum, rows = 0.0, []
    for j, e in enumerate(ev):
        cum += e
        rows.append((f"PC{j + 1}", float(e), float(cum)))
    report = spark.createDataFrame(rows, "component string, explained double, cumulative double")
    load = spark.createDataFrame([(c, float(mat[i, 0] * signs[0])) for i, c in enumerate(list(cols)[:n_loadings])],
                                 "variable string, pc1_loading double")
    arr = vector_to_array("_pc")
    scores = model.transform(df).select(*[c for c in df.columns if c not in cols],
                                        *[(arr[j] * signs[j]).alias(f"PC{j + 1}") for j in range(len(signs))])
    return scores, report, load


# --- M6 / M7 -----------------------------------------------------------------------------
def standardize(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """M6: per-series z-score with the population standard deviation."""
    st = df.groupBy(*[F.col(c).alias(f"_key_{c}") for c in keys]).agg(
        *[F.avg(c).alias(f"_mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    j = df.join(st, same)
    return j.select(*[c for c in df.columns if c not in cols],
                    *[F.when(F.col(f"_sd_{c}") > 0, (F.col(c) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}"))
                      .otherwise(F.lit(0.0)).alias(c) for c in cols])


def robust_scale(df: DataFrame, keys: Sequence[str], cols: Sequence[str], fit_mask: str) -> DataFrame:
    """M7: (x - median) / IQR with median and quartiles fitted on the rows
    where ``fit_mask`` holds (train rows only), exact quantiles; IQR 0 ->
    scale 1 (as scikit-learn)."""
    keys = list(keys)
    fit = df.filter(F.col(fit_mask))
    long = fit.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("_var"), F.col(c).cast("double").alias("_v"))
                                                for c in cols])))
    q = exact_quantiles(long, keys + ["_var"], "_v", [0.25, 0.5, 0.75], ["_q1", "_q2", "_q3"])
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("_var") == c, F.struct("_q1", "_q2", "_q3"))).alias(f"_q_{c}")
                                  for c in cols])
    j = join_by_keys(df, wide, keys, "left")
    out = []
    for c in cols:
        qq = F.col(f"_q_{c}")
        iqr = qq["_q3"] - qq["_q1"]
        out.append(((F.col(c) - qq["_q2"]) / F.when(iqr != 0, iqr).otherwise(F.lit(1.0))).alias(c))
    return j.select(*[c for c in df.columns if c not in cols], *out)


# --- learners -----------------------------------------------------------------------------
@dataclass
class ConstantModel:
    """A learner that saw one class predicts that class everywhere."""
    value: float

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("p", F.lit(float(self.value)))


def estimator(kind: str, params: dict | None = None, weight: str | None = None, n_features: int | None = None):
    p = dict(params or {})
    common = dict(featuresCol=FEATURES, labelCol="label")
    if weight and kind in ("rf", "gbt", "lr", "svm", "et"):
        common["weightCol"] = weight
    if kind == "rf":
        return RandomForestClassifier(seed=7, **common, **p)
    if kind == "et":
        return RandomForestClassifier(seed=7, bootstrap=False, featureSubsetStrategy="sqrt", **common, **p)
    if kind == "gbt":
        return GBTClassifier(seed=7, **common, **p)
    if kind == "lr":
        return LogisticRegression(**common, **p)
    if kind == "svm":
        return LinearSVC(**common, **p)
    if kind == "mlp":
        hidden = p.pop("hidden", [16])
        return MultilayerPerceptronClassifier(seed=7, layers=[n_features, *hidden, 2], **common, **p)
    raise ValueError(kind)


# Search spaces (MLlib parameter names).
GRIDS = {
    "rf": {"numTrees": [50, 100, 200], "maxDepth": [5, 8, 10], "minInstancesPerNode": [1, 2, 5]},
    "et": {"numTrees": [50, 100, 200], "maxDepth": [5, 8, 10], "minInstancesPerNode": [1, 2, 5]},
    "gbt": {"maxIter": [20, 50], "maxDepth": [3, 5], "stepSize": [0.05, 0.1], "subsamplingRate": [0.8, 1.0]},
    "lr": {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0]},
    "svm": {"regParam": [0.001, 0.01, 0.1]},
    "mlp": {"maxIter": [100, 200], "hidden": [[16], [32, 16]]},
}


def _positive_score(model_out: DataFrame, kind: str) -> DataFrame:
    if kind == "svm":
        return model_out.withColumn("p", vector_to_array("rawPrediction")[1])
    return model_out.withColumn("p", vector_to_array("probability")[1])


def fit(kind: str, train: DataFrame, params: dict | None = None, weight: str | None = None,
        classes: list | None = None, n_features: int | None = None):
    """Fit one learner (M12-M17) with the single-class guard.
    ``classes`` (the labels present) may be passed to skip a scan."""
    cls = classes if classes is not None else [r[0] for r in train.select("label").distinct().collect()]
    if len(cls) < 2:
        return ConstantModel(float(cls[0]) if cls else 0.0)
    if kind == "mlp" and n_features is None:
        n_features = len(train.select(FEATURES).first()[0])
    return estimator(kind, params, weight, n_features).fit(train)


def predict(model, kind: str, df: DataFrame) -> DataFrame:
    if isinstance(model, ConstantModel):
        return model.transform(df)
    cols = df.columns
    return _positive_score(model.transform(df), kind).select(*cols, "p")


def fold_table(train: DataFrame, spec, k_folds: int = 3) -> tuple[DataFrame, dict]:
    """Expanding time folds (W23, per series) checkpointed once, plus the
    labels present in each (fold, role) -- a table of at most 4k rows."""
    from cirro.operators.splits import time_folds
    from cirro.session import cut_lineage
    folds = cut_lineage(time_folds(train, spec, k_folds))
    cls: dict = {}
    for r in folds.groupBy("fold", "role", "label").count().collect():
        cls.setdefault((r["fold"], r["role"]), []).append(r["label"])
    return folds, cls


def search_settings(kind: str, n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` different seeded settings of the grid; all of a smaller grid."""
    grid = GRIDS[kind]
    every = [dict(zip(grid, values)) for values in product(*grid.values())]
    return random.Random(seed).sample(every, min(n_iter, len(every)))


def random_search(kind: str, train: DataFrame, spec, n_iter: int = 3, k_folds: int = 3, beta: float = 2.0,
                  seed: int = 42, weight: str | None = None, folds=None, classes: list | None = None,
                  n_features: int | None = None, parallelism: int = 4):
    """``n_iter`` seeded settings from the grid, each scored by mean
    F-beta (threshold 0.5; margin 0 for the SVM) over expanding time folds
    (W23, per series, so folds need no global ordering); the best setting
    is refitted on all training rows.  (A k-fold CrossValidator would
    train on later folds too.)  ``parallelism`` fits run at a time."""
    settings = search_settings(kind, n_iter, seed)
    if folds is None:
        folds = fold_table(train, spec, k_folds)
    fdf, fcls = folds

    def score(task):
        s, i = task
        tr = fdf.filter((F.col("fold") == i) & (F.col("role") == "train")).drop("fold", "role")
        te = fdf.filter((F.col("fold") == i) & (F.col("role") == "test")).drop("fold", "role")
        m = fit(kind, tr, s, weight, fcls.get((i, "train"), []), n_features)
        thr = 0.0 if kind == "svm" and not isinstance(m, ConstantModel) else 0.5
        return fbeta_at(predict(m, kind, te), "p", thr, beta)

    with ThreadPool(parallelism) as pool:
        scores = pool.map(inheritable_thread_target(train.sparkSession)(score), [(s, i) for s in settings for i in range(k_folds)], chunksize=1)
    means = [sum(scores[j * k_folds:(j + 1) * k_folds]) / k_folds for j in range(len(settings))]
    best_score = max(means)
    best = settings[means.index(best_score)]
    return fit(kind, train, best, weight, classes, n_features), best, best_score


def platt_calibrate(scored: DataFrame, raw: str = "p"):
    """1-D logistic regression of the label on the raw score (almost
    no regularisation); identity when the fitting rows have one class."""
    cls = [r[0] for r in scored.select("label").distinct().collect()]
    if len(cls) < 2:
        return None
    va = VectorAssembler(inputCols=[raw], outputCol="_cf")
    lr = LogisticRegression(featuresCol="_cf", labelCol="label", regParam=1e-6, maxIter=200)
    return Pipeline(stages=[va, lr]).fit(scored)


def apply_calibration(cal, df: DataFrame, raw: str = "p", out: str = "p_cal") -> DataFrame:
    if cal is None:
        return df.withColumn(out, F.col(raw))
    cols = df.columns
    return cal.transform(df).withColumn(out, vector_to_array("probability")[1]).select(*cols, out)


def fbeta_at(df: DataFrame, p: str, thr, beta: float = 2.0) -> float:
    c = confusion(df, [], p=p, thr=thr).select(fbeta_col(F.col("tp"), F.col("fp"), F.col("fn"), beta)).first()
    return float(c[0])


def feature_importances(model, cols: Sequence[str], k: int = 20):
    """The true top-k importances (the reference sorted only the
    first 20 columns)."""
    imp = model.featureImportances.toArray()
    pairs = sorted(zip(cols, imp), key=lambda t: (-t[1], t[0]))[:k]
    return [(c, float(v)) for c, v in pairs]

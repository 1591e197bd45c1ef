"""Linear learners on training blocks: logistic regression (M14) and an RBF margin classifier.

The RBF kernel exp(-gamma |x - y|^2) is approximated by random Fourier
features: z(x) . z(y) with z(x) = sqrt(2 / m) cos(x W + b), W normal with
variance 2 gamma, b uniform in [0, 2 pi), both from a seed.  On them MLlib's
``LinearSVC`` is the kernel classifier; logistic regression is MLlib's, too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.operators.programs import TRAIN, Table, _decoded
from cirro.operators.trees import Constant


@dataclass
class FourierMap:
    w: np.ndarray
    b: np.ndarray

    @staticmethod
    def of(width: int, gamma: float, m: int = 256, seed: int = 7) -> "FourierMap":
        rng = np.random.default_rng(seed)
        return FourierMap(rng.normal(scale=np.sqrt(2 * gamma), size=(width, m)), rng.uniform(0, 2 * np.pi, m))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.b)) * np.cos(x @ self.w + self.b)


@dataclass
class Linear:
    """sigmoid of a weighted sum: a probability for logistic regression, a squashed margin (0.5 at the border) for the SVM."""
    weights: np.ndarray
    bias: float
    map: FourierMap | None = None

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (self.map(x) if self.map else x) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def set_rows(table: Table, which: int, mapping: FourierMap | None = None) -> DataFrame:
    """label, features (vector, mapped) of the rows a set trains on."""
    width, n_sets = table.width, table.n_sets

    def run(batches):
        for batch in batches:
            for b in _decoded(batch, width, n_sets, ""):
                at = np.flatnonzero(b.role[which] == TRAIN)
                x = mapping(b.x[at]) if mapping else b.x[at]
                yield pa.RecordBatch.from_arrays([pa.array(b.y[at]), pa.ListArray.from_arrays(
                    pa.array(np.arange(len(at) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=["label", "v"])

    return table.blocks.mapInArrow(run, "label double, v array<double>").select("label", array_to_vector("v").alias("features"))


def mean_variance(table: Table, which: int) -> float:
    """Variance of all feature values of a set's rows (the 'scale' of gamma)."""
    width, n_sets = table.width, table.n_sets

    def run(batches):
        out = np.zeros(3)
        for batch in batches:
            for b in _decoded(batch, width, n_sets, ""):
                x = b.x[np.flatnonzero(b.role[which] == TRAIN)]
                out += [x.size, x.sum(), (x * x).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in out], names=["n", "s", "q"])

    r = table.blocks.mapInArrow(run, "n double, s double, q double").agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
    return max(r[2] / r[0] - (r[1] / r[0]) ** 2, 1e-12) if r[0] else 1.0


def _classes(rows: DataFrame) -> dict[float, int]:
    return {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}                  # two rows


def _weighted(rows: DataFrame, sizes: dict[float, int], balanced: bool) -> DataFrame:
    total = sum(sizes.values())
    weight = F.lit(1.0)
    for label, n in sizes.items():
        if balanced:
            weight = F.when(F.col("label") == label, total / (2.0 * n)).otherwise(weight)
    return rows.withColumn("weight", weight)


def fit_logistic(table: Table, which: int, c: float = 1.0, balanced: bool = True, max_iter: int = 100):
    rows = set_rows(table, which).persist()
    try:
        sizes = _classes(rows)
        if len(sizes) < 2:
            return Constant(next(iter(sizes), 0.0))
        m = LogisticRegression(weightCol="weight", regParam=1 / (c * sum(sizes.values())), maxIter=max_iter).fit(_weighted(rows, sizes, balanced))
        return Linear(m.coefficients.toArray(), float(m.intercept))
    finally:
        rows.unpersist()


def fit_svm(table: Table, which: int, c: float = 1.0, gamma: float | str = "scale", balanced: bool = False, m: int = 256, max_iter: int = 60, seed: int = 7):
    scale = {"scale": lambda: 1 / (table.width * mean_variance(table, which)), "auto": lambda: 1 / table.width}
    mapping = FourierMap.of(table.width, scale[gamma]() if gamma in scale else float(gamma), m, seed)
    rows = set_rows(table, which, mapping).persist()
    try:
        sizes = _classes(rows)
        if len(sizes) < 2:
            return Constant(next(iter(sizes), 0.0))
        svc = LinearSVC(weightCol="weight", regParam=1 / (c * sum(sizes.values())), maxIter=max_iter, standardization=False)
        fitted = svc.fit(_weighted(rows, sizes, balanced))
        return Linear(fitted.coefficients.toArray(), float(fitted.intercept), mapping)
    finally:
        rows.unpersist()

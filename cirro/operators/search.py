"""Random search over all learners (M12-M18): every setting on every fold.

The tree learners and the network are programs (``operators.programs``): all
their settings and folds are fitted together.  The linear ones are MLlib
fits, a few at a time.  Folds are sets of one training table, so its rows are
binned and stored once.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.util import inheritable_thread_target

from cirro.operators.kernel import fit_logistic, fit_svm
from cirro.operators.neural import network
from cirro.operators.programs import Fit, Table, fit_all, test_confusion
from cirro.operators.trees import boosting, extra_trees, random_forest

_FOREST = {"trees": [50, 100, 200], "depth": [5, 8, 10], "min_leaf": [1, 2, 4], "balanced": [True]}
_BOOST = {"rounds": [20, 50], "depth": [3, 5], "rate": [0.05, 0.1], "subsample": [0.7, 0.8, 0.9]}
GRIDS: dict[str, dict[str, list]] = {
    "rf": _FOREST,
    "et": _FOREST,
    "xgb": _BOOST | {"columns": [0.7, 0.8, 0.9], "l1": [0.0, 0.1, 0.5], "l2": [1.0, 2.0, 5.0]},
    "lgb": _BOOST | {"columns": [0.7, 0.8, 0.9], "l1": [0.0, 0.1, 0.5], "l2": [1.0, 2.0, 5.0], "leaves": [15, 31], "balanced": [True, False]},
    "gb": _BOOST | {"min_split": [2, 5, 10]},
    "lr": {"c": [0.1, 1.0, 10.0, 100.0]},
    "svm": {"c": [0.1, 1.0, 10.0], "gamma": ["scale", "auto", 0.1, 1.0], "balanced": [True, False]},
    "mlp": {"hidden": [(50,), (100,), (50, 25), (100, 50)], "activation": ["relu", "tanh"], "alpha": [0.0001, 0.001, 0.01], "rate": [0.001, 0.01]},
}
_MODE = {"xgb": dict(mode="newton", min_hessian=1.0), "lgb": dict(mode="leafwise", min_leaf=20), "gb": dict(mode="classic")}
_LINEAR = {"lr": fit_logistic, "svm": fit_svm}


def search_settings(kind: str, n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` different seeded settings of the grid; all of a smaller grid."""
    grid = GRIDS[kind]
    every = [dict(zip(grid, values)) for values in product(*grid.values())]
    return random.Random(seed).sample(every, min(n_iter, len(every)))


def as_fit(kind: str, table: Table, which: int, params: dict) -> Fit:
    if kind in _MODE:
        return Fit(boosting, which, {"edges": table.edges, **_MODE[kind], **params})
    if kind == "rf":
        return Fit(random_forest, which, {"edges": table.edges, **params})
    return Fit({"et": extra_trees, "mlp": network}[kind], which, params)


def fit_many(table: Table, wanted: Sequence[tuple[str, int, dict]], parallelism: int = 8) -> list:
    """Models of (kind, set, params), in order."""
    out: list = [None] * len(wanted)
    linear = [i for i, (kind, _, _) in enumerate(wanted) if kind in _LINEAR]
    others = [i for i, (kind, _, _) in enumerate(wanted) if kind not in _LINEAR]

    def one(i):
        kind, which, params = wanted[i]
        out[i] = _LINEAR[kind](table, which, **params)

    spark = table.blocks.sparkSession
    with ThreadPool(parallelism) as pool:
        for i, model in zip(others, fit_all(table, [as_fit(wanted[i][0], table, *wanted[i][1:]) for i in others])):
            out[i] = model
        pool.map(inheritable_thread_target(spark)(one), linear, chunksize=1)
    return out


def f_beta(tp: float, fp: float, fn: float, beta: float = 2.0) -> float:
    b = beta * beta
    return (1 + b) * tp / ((1 + b) * tp + b * fn + fp) if tp else 0.0


def search(table: Table, kinds: Sequence[str], folds: Sequence[int], whole: int, n_iter: int = 10, seed: int = 42, beta: float = 2.0) -> dict[str, tuple]:
    """kind -> (model fitted on the set ``whole``, its setting, mean F-beta of that setting over the sets ``folds``)."""
    tried = [(kind, s) for kind in kinds for s in search_settings(kind, n_iter, seed)]
    models = fit_many(table, [(kind, f, s) for kind, s in tried for f in folds])
    counts = test_confusion(table, [(f, m) for (f, m) in zip([f for _ in tried for f in folds], models)])
    scores = [sum(f_beta(*counts[i * len(folds) + j], beta) for j in range(len(folds))) / len(folds) for i in range(len(tried))]
    best = {}
    for (kind, s), score in zip(tried, scores):
        if kind not in best or score > best[kind][1]:
            best[kind] = (s, score)
    final = fit_many(table, [(kind, whole, best[kind][0]) for kind in kinds])
    return {kind: (model, *best[kind]) for kind, model in zip(kinds, final)}

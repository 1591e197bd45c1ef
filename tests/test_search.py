"""The model search: every setting on every fold, and all loadings."""

from unittest import mock

import pytest
from pyspark.ml.linalg import Vectors

from cirro.operators import models as ML
from cirro.plans import q_models
from cirro.plans.series import SeriesSpec


def test_registered_training_runs_the_full_search(spark):
    q_models._CACHE.clear()
    with mock.patch.object(q_models.TR, "train") as train:
        q_models.trained(spark, "x")
    q_models._CACHE.clear()
    assert train.call_args.args == (spark, "x") and not train.call_args.kwargs
    assert q_models.TR.train.__defaults__[-2:] == (10, 3)


def test_search_tries_different_settings():
    for kind, grid in ML.GRIDS.items():
        size = 1
        for v in grid.values():
            size *= len(v)
        got = ML.search_settings(kind, 10)
        assert len(got) == len({str(s) for s in got}) == min(10, size) and all(s[k] in grid[k] for s in got for k in grid)
        assert got == ML.search_settings(kind, 10)


def test_search_scores_every_setting_on_every_fold(spark):
    rows = [("a", i, i % 2, Vectors.dense([float(i % 2) + 0.01 * (i % 7), float(i % 5)])) for i in range(40)]
    df = spark.createDataFrame(rows, ["series_id", "ts", "label", "features"])
    seen = []
    real = ML.fit

    def fit(kind, train, params=None, *more):
        seen.append(params["regParam"])
        return real(kind, train, params, *more)

    with mock.patch.object(ML, "fit", fit):
        model, best, score = ML.random_search("lr", df, SeriesSpec(keys=("series_id",), order="ts"), n_iter=10, k_folds=3, classes=[0, 1])
    assert sorted(seen[:-1]) == sorted(ML.GRIDS["lr"]["regParam"] * 3) and seen[-1] == best["regParam"]
    assert score == pytest.approx(1.0) and best == ML.search_settings("lr", 10)[0]


def test_pca_report_gives_all_loadings(spark):
    cols = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([[float((i * 7 + j * j) % 11 + i * (j % 3)) for j in range(12)] for i in range(30)], cols)
    assert [r["variable"] for r in ML.pca_report(df, cols, 2)[2].collect()] == cols

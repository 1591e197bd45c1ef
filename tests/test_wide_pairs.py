"""Covariances of many columns as matrix products against the pairwise aggregates."""

import numpy as np
import pytest

from cirro.operators import aggregates as A


def frame(spark, d, n, shift=0.0, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + shift
    rows = []
    for i, v in enumerate(x):
        cells = [None if rng.random() < 0.08 else float(c) for c in v]
        cells[3] = 5.0                                                  # a constant column
        cells[4] = None                                                 # an empty one
        rows.append((None if i % 11 == 0 else "ab"[i % 2], *cells))
    return spark.createDataFrame(rows, "g string, " + ", ".join(f"c{j} double" for j in range(d))), [f"c{j}" for j in range(d)]


def table(df):
    return {(r["g"], r["var_i"], r["var_j"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("kind", ["cov", "corr"])
@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_equals_the_pairwise_form(spark, monkeypatch, kind, shift):
    df, cols = frame(spark, 12, 300, shift)
    want = table(A.pair_stats_long(df, ["g"], cols, kind))
    monkeypatch.setattr(A, "WIDE", 2)
    monkeypatch.setattr(A.co_moments, "__defaults__", (20, 3))           # few rows a task, three levels
    got = table(A.pair_stats_long(df, ["g"], cols, kind))
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-7, abs=1e-6 if kind == "cov" else 1e-7), k


def test_all_features_of_the_reference(spark):
    """219 columns: 24,090 pairs."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 219))
    cols = [f"c{j}" for j in range(219)]
    df = spark.createDataFrame([("s", *map(float, v)) for v in x], ["g", *cols])
    got = table(A.pair_stats_long(df, ["g"], cols, "cov"))
    want = np.cov(x.T)
    assert len(got) == 219 * 219
    assert max(abs(got["s", cols[i], cols[j]] - want[i, j]) for i in range(0, 219, 7) for j in range(219)) < 1e-10


def test_no_rows(spark):
    df, cols = frame(spark, 40, 3)
    assert A.pair_stats_long(df.limit(0), ["g"], cols).count() == 0

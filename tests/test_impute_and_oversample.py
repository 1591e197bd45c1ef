"""k-NN imputation over shared columns and oversampling, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirro.operators.fill import fill_cascade, knn_impute
from cirro.operators.sampling import append_synthetic, oversample_minority
from cirro.plans.series import SeriesSpec


def plain(rows, k):
    """rows: (key, group, values with None)."""
    out = {}
    d = len(rows[0][2])
    for key, g, v in rows:
        new = list(v)
        for c in range(d):
            if v[c] is not None:
                continue
            found = []
            for key2, g2, u in rows:
                shared = [i for i in range(d) if v[i] is not None and u[i] is not None]
                if g2 == g and u[c] is not None and shared:
                    found.append((float(np.sqrt(sum((v[i] - u[i]) ** 2 for i in shared)) * np.sqrt(d / len(shared))), key2, u[c]))
            best = sorted(found)[:k]
            zero = [x for dist, _, x in best if dist == 0]
            if zero:
                new[c] = float(np.mean(zero))
            elif best:
                new[c] = sum(x / dist for dist, _, x in best) / sum(1 / dist for dist, _, _ in best)
        out[key] = new
    return out


@pytest.mark.parametrize("d", [2, 4])
def test_imputation_over_shared_columns(spark, d):
    rng = np.random.default_rng(d)
    rows = []
    for i in range(160):
        v = [None if rng.random() < 0.25 else float(round(x, 1)) for x in rng.normal(size=d) * 3]
        rows.append((f"k{i:03d}", "ab"[i % 2] if i % 13 else None, v))
    rows.append(("alone", "z", [1.0] + [None] * (d - 1)))
    cols = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([(k, g, *v, "extra") for k, g, v in rows], f"key string, grp string, {', '.join(c + ' double' for c in cols)}, note string")
    got = {r["key"]: [r[c] for c in cols] for r in knn_impute(df, "key", cols, 5, "grp").collect()}
    want = plain(rows, 5)
    assert got.keys() == want.keys()
    for key, v in want.items():
        for a, b in zip(got[key], v):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9)), key


def test_nothing_to_fill(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", None, 2.0)], "key string, x double, y double")
    assert sorted(map(str, knn_impute(df, "key", ["x", "y"]).collect())) == sorted(map(str, df.collect()))
    assert knn_impute(df.limit(0), "key", ["x", "y"]).count() == 0


def test_cascade_runs_all_steps(spark):
    """Interpolated, from neighbours, median; in this order."""
    x = [1.0, None, 3.0, None, None, None, None, 5.0, 1.0, None]
    y = [10.0, 20.0, 30.0, 30.0, 10.0, None, 30.0, 50.0, 10.0, None]
    df = spark.createDataFrame([("s", i, a, b) for i, (a, b) in enumerate(zip(x, y))], "series_id string, i long, x double, y double")
    df = df.select("series_id", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(hours=F.col("i"))).alias("ts"), "i", "x", "y")
    out = {r["i"]: (r["x"], r["y"]) for r in fill_cascade(df, SeriesSpec(), ["x", "y"], limit=1, k=1).collect()}
    assert out[1][0] == pytest.approx(2.0) and out[3][0] == pytest.approx(3.4)
    assert out[4][0] == 1.0 and out[5][1] == pytest.approx(20.0)
    assert all(v is not None for r in out.values() for v in r)


def test_synthetic_rows_lie_between_neighbours_in_all_features(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6))
    cols = [f"f{i}" for i in range(6)]
    rows = [(f"r{i}", int(i < 14), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["key", "label", *cols])
    syn = oversample_minority(df, "key", cols, "label", 3).collect()
    assert len(syn) == 46 - 14 and {r["label"] for r in syn} == {1}
    per = {}
    mino = x[:14]
    for r in syn:
        i = int(r["synthetic_id"].split("-")[0][1:])
        per[i] = per.get(i, 0) + 1
        v = np.array([r[c] for c in cols])
        d = np.linalg.norm(mino - x[i], axis=1)
        ok = False
        for j in np.argsort(d)[1:4]:
            lam = (v - x[i]) @ (mino[j] - x[i]) / d[j] ** 2
            ok |= -1e-9 <= lam <= 1 and np.allclose(v, x[i] + lam * (mino[j] - x[i]))
        assert ok
    assert set(per.values()) <= {2, 3} and len(per) == 14
    again = oversample_minority(df.repartition(5), "key", cols, "label", 3).collect()
    assert sorted(map(str, syn)) == sorted(map(str, again))
    both = append_synthetic(df.select(*cols, "label"), spark.createDataFrame(syn))
    assert {r["label"]: r["count"] for r in both.groupBy("label").count().collect()} == {0: 46, 1: 46}


def test_oversampling_of_one_class_or_balanced_rows(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 1.0)], "key string, label int, f double")
    assert oversample_minority(df, "key", ["f"]).count() == 0
    two = df.union(spark.createDataFrame([("c", 0, 0.0), ("d", 0, 1.0)], df.schema))
    assert oversample_minority(two, "key", ["f"]).count() == 0

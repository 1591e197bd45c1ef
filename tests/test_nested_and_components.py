"""Recursive sanitising and the unscaled components, against plain Python."""

import math

import numpy as np

from cirro.functions.weather import sanitize_all
from cirro.operators.models import pca_features

NAN, INF = float("nan"), float("inf")


def test_sanitize_reaches_every_depth(spark):
    schema = "a double, f float, s struct<x: double, t: struct<y: array<double>, n: string>>, m map<string, array<struct<z: double>>>, `odd name` double, i int"
    rows = [(NAN, INF, (INF, ([1.0, -INF, None], "n")), {"k": [(NAN,), (2.0,)], "e": None}, -INF, 1), (1.0, 2.0, None, None, None, None), (None, None, (None, None), {}, 0.0, 2)]
    df = spark.createDataFrame(rows, schema)
    for default in (None, 0.0):
        out = sanitize_all(df, default)
        assert [f.name for f in out.schema] == [f.name for f in df.schema]
        a, b, c = out.collect()
        assert a["a"] == default and a["f"] == default and a["s"]["x"] == default and a["s"]["t"]["y"] == [1.0, default, None] and a["s"]["t"]["n"] == "n"
        assert [r["z"] for r in a["m"]["k"]] == [default, 2.0] and a["m"]["e"] is None and a["odd name"] == default and a["i"] == 1
        assert b["a"] == 1.0 and b["s"] is None and b["m"] is None and b["odd name"] is None
        assert c["s"]["x"] is None and c["s"]["t"] is None and c["m"] == {}


def test_components_of_unscaled_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) * [1, 5, 20, 0.1] + [3, -2, 100, 0]
    df = spark.createDataFrame([(i, *map(float, v), i < 120) for i, v in enumerate(x)], "i int, a double, b double, c double, d double, fit boolean")
    out = pca_features(df, ["a", "b", "c", "d"], 3, "fit").orderBy("i").toPandas()
    fit = x[:120]
    values, vectors = np.linalg.eigh(np.cov(fit.T))
    for j in range(3):
        v = vectors[:, -1 - j]
        v = v * np.sign(v[np.abs(v).argmax()])
        assert np.allclose(out[f"pca_{j + 1}"], (x - fit.mean(axis=0)) @ v, atol=1e-8)
    assert not any(math.isnan(v) for v in out["pca_3"])

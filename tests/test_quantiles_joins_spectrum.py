"""Exact quantiles, nearest stations and the spectrum against numpy."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirro.operators.joins import nearest_k
from cirro.operators.quantiles import exact_quantiles
from cirro.operators.spectrum import hurst_rs, window_spectrum
from cirro.plans.series import SeriesSpec


def test_exact_quantiles_hot_group(spark):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=3000)
    cold = rng.normal(size=7)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("one", 2.5)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = {r["g"]: r for r in exact_quantiles(df, ["g"], "x", [0.25, 0.5, 0.8]).collect()}
    for g, vals in (("hot", hot), ("cold", cold), ("one", np.array([2.5]))):
        for name, q in (("q25", 0.25), ("q50", 0.5), ("q80", 0.8)):
            assert out[g][name] == pytest.approx(float(np.quantile(vals, q)))


@pytest.mark.parametrize("max_rows", [1 << 20, 40])
def test_exact_quantiles_with_a_value_in_half_the_rows(spark, monkeypatch, max_rows):
    """Equal rows are one counted row, groups are narrowed down to few rows, keys may be null."""
    from cirro.operators import quantiles
    rng = np.random.default_rng(8)
    groups = {"rain": np.concatenate([np.zeros(2500), rng.gamma(1.0, 3.0, 2400), -rng.gamma(1.0, 3.0, 100)]), None: rng.integers(0, 4, 900).astype(float),
              "flat": np.full(500, 7.0), "few": np.array([3.0, 1.0]), "smooth": rng.normal(size=2000)}
    df = spark.createDataFrame([(g, 1, float(v)) for g, vs in groups.items() for v in vs] + [("gone", 1, None)], "g string, h int, x double")
    held = []
    real = quantiles._narrowed

    def seen(*args):
        out = real(*args)
        held.extend(r["n"] for r in out.groupBy("_qk", "_cell").agg(F.countDistinct("_x").alias("n")).collect())
        return out

    monkeypatch.setattr(quantiles, "_narrowed", seen)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    out = {r["g"]: r for r in exact_quantiles(df, ["g", "h"], "x", probs, [f"p{i}" for i in range(7)], n_buckets=8, max_rows=max_rows).collect()}
    assert set(out) == set(groups) and len(next(iter(out.values()))) == 9
    for g, vs in groups.items():
        assert [out[g][f"p{i}"] for i in range(7)] == pytest.approx(np.quantile(vs, probs).tolist())
    assert max(held, default=0) <= max_rows and bool(held) == (max_rows == 40)


def test_statistics_of_null_keys_are_joined_back(spark):
    from cirro.operators.fill import fill_with_stat
    from cirro.operators.models import robust_scale
    df = spark.createDataFrame([(None, i, float(i) if i else None, True) for i in range(5)], "series_id string, ts int, x double, fit boolean")
    spec = SeriesSpec(keys=("series_id",), order="ts")
    for how in ("median", "mean"):
        assert {r["ts"]: r["x"] for r in fill_with_stat(df, spec, ["x"], how).collect()} == {0: 2.5, 1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0}
    assert {r["ts"]: r["x"] for r in robust_scale(df, ["series_id"], ["x"], "fit").collect()}[4] == pytest.approx(1.0)


@pytest.mark.parametrize("metric", ["degrees", "haversine"])
def test_nearest_k_brute_force(spark, metric):
    rng = np.random.default_rng(11)
    pts = [(i, float(rng.uniform(-60, 60)), float(rng.uniform(-170, 170))) for i in range(40)]
    sts = [(f"S{i:03d}", float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180))) for i in range(60)]
    P = spark.createDataFrame(pts, "point_id long, lat double, lon double")
    S = spark.createDataFrame(sts, "station_id string, lat double, lon double")
    got = {}
    for r in nearest_k(P, S, 3, metric).collect():
        got.setdefault(r["point_id"], []).append((r["rank"], r["station_id"]))

    def dist(a, b):
        if metric == "degrees":
            return math.hypot(a[0] - b[0], a[1] - b[1])
        la1, lo1, la2, lo2 = map(math.radians, (a[0], a[1], b[0], b[1]))
        h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
        return 2 * math.asin(math.sqrt(h))
    for pid, la, lo in pts:
        exp = sorted(sts, key=lambda s: (dist((la, lo), (s[1], s[2])), s[0]))[:3]
        assert [s for _, s in sorted(got[pid])] == [s[0] for s in exp]


def test_spectrum_paths_agree_with_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.sin(np.arange(120) * 2 * np.pi / 8) * 3 + rng.normal(size=120)
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, x double")
    n, step = 32, 8
    spec = SeriesSpec()
    fft = {r["win"]: r for r in window_spectrum(df, spec, "x", n, step, "fft").collect()}
    basis = {r["win"]: r for r in window_spectrum(df, spec, "x", n, step, "basis").collect()}
    wins = list(range(n, len(x), step))
    assert sorted(fft) == list(range(len(wins)))
    for a, i in enumerate(wins):
        seg = x[i - n:i] - x[i - n:i].mean()
        amp = np.abs(np.fft.fft(seg))[: n // 2]
        assert fft[a]["amplitude"] == pytest.approx(list(amp), abs=1e-9)
        assert basis[a]["amplitude"] == pytest.approx(list(amp), abs=1e-7)
        assert fft[a]["dominant_freq"] == pytest.approx((np.argmax(amp[1:]) + 1) / n)
        assert fft[a]["spectral_energy"] == pytest.approx(float((amp ** 2).sum()))


def test_hurst_reading(spark):
    rng = np.random.default_rng(4)
    trend = np.cumsum(rng.normal(size=168))        # persistent
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v)) for i, v in enumerate(trend)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, x double")
    h = hurst_rs(df, SeriesSpec(), "x").first()
    assert h["hurst"] > 0.5 and h["reading"] == "persistent"

"""Long frames against pandas and direct recomputation: groups of any size, far from zero, split into blocks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from cirro.operators import frames as FR
from cirro.operators import windows as W
from cirro.plans.series import SeriesSpec

STATS = ("mean", "std", "min", "max", "skew", "kurt")


def direct(x, n, stat, least):
    """Each frame worked out alone."""
    out = []
    for i in range(len(x)):
        v = x[max(0, i - n + 1):i + 1]
        v = v[~np.isnan(v)]
        m = len(v)
        if m < least or m < {"std": 2, "skew": 3, "kurt": 4}.get(stat, 1):
            out.append(np.nan)
            continue
        d = v - v.mean()
        d = d - d.mean()
        m2, m3, m4 = (d ** 2).sum(), (d ** 3).sum(), (d ** 4).sum()
        flat = v.max() == v.min()
        out.append({"mean": v.mean(), "std": np.sqrt(m2 / max(m - 1, 1)), "min": v.min(), "max": v.max(), "sum": v.sum(),
                    "skew": 0.0 if flat or stat != "skew" else np.sqrt(m) * m3 / m2 ** 1.5 * np.sqrt(m * (m - 1)) / (m - 2),
                    "kurt": -3.0 if flat or stat != "kurt" else (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * (m * m4 / m2 ** 2 - 3) + 6)}[stat])
    return np.array(out)


@pytest.mark.parametrize("shift", [0.0, 1e9, -1e6])
@pytest.mark.parametrize("n", [1, 2, 5, 24, 168])
def test_columns_of_groups(shift, n):
    """Groups of 1 to 700 rows, with gaps, constant stretches and a jump."""
    rng = np.random.default_rng(int(n + abs(shift)) % 1000)
    groups = [1, 2, 3, 5, 23, 24, 25, 169, 700]
    parts = []
    for g in groups:
        x = rng.normal(size=g) * 3
        x[rng.random(g) < 0.15] = np.nan
        if g > 100:
            x[20:60] = 2.0
            x[80:] += 1000
        parts.append(x + shift)
    values = np.concatenate(parts)
    starts = np.cumsum([0, *groups[:-1]])
    frames = [FR.Frame(s, s, "x", n, max(1, n // 4)) for s in (*STATS, "sum")]
    got = FR.frame_columns(starts, len(values), frames, {"x": values})
    for f in frames:
        want = np.concatenate([direct(p, n, f.stat, f.least) for p in parts])
        assert (np.isnan(got[f.name]) == np.isnan(want)).all(), f.stat
        here = ~np.isnan(want)
        assert np.allclose(got[f.name][here], want[here], rtol=1e-9, atol=2e-6 if shift else 1e-9), f.stat


def test_correlation():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=300) + 1e9, rng.normal(size=300)
    y[::7] = np.nan
    x[100:140] = 5.0
    got = FR.frame_columns(np.array([0]), 300, [FR.Frame("c", "corr", "x", 30, 20, "y")], {"x": x, "y": y})["c"]
    for i in range(300):
        v, u = x[max(0, i - 29):i + 1], y[max(0, i - 29):i + 1]
        ok = ~np.isnan(u)
        if ok.sum() < 20 or v[ok].max() == v[ok].min():
            assert np.isnan(got[i])
        elif abs(v[ok].max() - v[ok].min()) < 100:
            assert abs(got[i] - np.corrcoef(v[ok] - 1e9, u[ok])[0, 1]) < 1e-6


@pytest.mark.parametrize("block_rows", [1000, 11, 4])
def test_blocks_and_buffers(spark, monkeypatch, block_rows):
    """Two series and a nameless one, frames longer than a block, a buffer smaller than a block."""
    monkeypatch.setattr(FR, "BUFFER_ROWS", 9)
    rng = np.random.default_rng(5)
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), None if rng.random() < 0.1 else float(v), i)
            for s, n in (("a", 70), ("b", 13), (None, 5)) for i, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, x double, extra int").repartition(3)
    out = W.rolling(df, SeriesSpec(block_rows=block_rows), ["x"], [3, 24], STATS, 2).toPandas()
    assert out.columns.tolist()[:4] == ["series_id", "ts", "x", "extra"] and len(out) == len(rows)
    for name, g in out.groupby("series_id", dropna=False):
        g = g.sort_values("ts")
        for n in (3, 24):
            for s in STATS:
                want = direct(g["x"].to_numpy(dtype=float), n, s, 2)
                assert np.allclose(g[f"x_{s}_{n}"].to_numpy(dtype=float), want, equal_nan=True), (name, s, n)


def test_same_values_as_pandas_for_a_panel(spark):
    vals = np.random.default_rng(1).gamma(1.0, 2.0, 60)
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v)) for i, v in enumerate(vals)], "series_id string, ts timestamp_ntz, x double")
    out = W.accumulations(df, SeriesSpec(block_rows=17), "x", [6, 48, 100]).toPandas().sort_values("ts")
    for n in (6, 48):
        r = pd.Series(vals).rolling(n, min_periods=1)
        assert np.allclose(out[f"acc_{n}"], r.sum()) and np.allclose(out[f"max_{n}"], r.max())
    assert out["acc_100"].isna().all()

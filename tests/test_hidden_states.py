"""Hidden-state models against a plain forward-backward, Viterbi and Baum-Welch per series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirro.operators import hidden_states as H
from cirro.operators.aggregates import regime_stability
from cirro.plans.series import SeriesSpec

COLS = ["p", "t"]
SCHEMA = "series_id string, ts long, p double, t double"


def series(seed, n, name, missing=()):
    rng = np.random.default_rng(seed)
    means, sds, state, out = [(-2, 0), (0, 1), (3, -1)], [0.3, 0.7, 1.5], 0, []
    for i in range(n):
        if rng.random() < 0.08:
            state = int(rng.integers(0, 3))
        x = rng.normal(means[state], sds[state])
        out.append((name, i, None if i in missing else float(10 + 2 * x[0]), float("nan") if i in missing and i % 2 else float(5 * x[1])))
    return out


def plain_density(x, model):
    out = np.zeros((len(x), len(model.start)))
    for t, row in enumerate(x):
        if np.isnan(row).any():
            continue
        for k in range(len(model.start)):
            c, r = model.cov[k], row - model.mean[k]
            out[t, k] = -0.5 * (r @ np.linalg.inv(c) @ r + np.log(np.linalg.det(c)) + len(row) * np.log(2 * np.pi))
    return out


def plain_forward_backward(x, model):
    """Posteriors, expected moves, log likelihood, all by log-sum-exp."""
    lb, n, k = plain_density(x, model), len(x), len(model.start)
    la, lm = np.zeros((n, k)), np.log(model.move)
    la[0] = np.log(model.start) + lb[0]
    for t in range(1, n):
        la[t] = np.logaddexp.reduce(la[t - 1][:, None] + lm, axis=0) + lb[t]
    be = np.zeros((n, k))
    for t in range(n - 2, -1, -1):
        be[t] = np.logaddexp.reduce(lm + (lb[t + 1] + be[t + 1])[None], axis=1)
    total = np.logaddexp.reduce(la[-1])
    moves = np.zeros((k, k))
    for t in range(1, n):
        moves += np.exp(la[t - 1][:, None] + lm + (lb[t] + be[t])[None] - total)
    return np.exp(la + be - total), moves, total


def plain_path(x, model):
    lb, n, k = plain_density(x, model), len(x), len(model.start)
    d, back = np.log(model.start) + lb[0], []
    for t in range(1, n):
        ways = d[:, None] + np.log(model.move)
        back.append(ways.argmax(axis=0))
        d = ways.max(axis=0) + lb[t]
    s = [int(d.argmax())]
    for b in reversed(back):
        s.append(int(b[s[-1]]))
    return np.array(s[::-1])


def plain_fit(x, k, max_iter, tol):
    whole = x[~np.isnan(x).any(axis=1)]
    model, before = H.first_model(whole.T @ whole / len(whole), k), -np.inf
    for _ in range(max_iter):
        g, moves, log = plain_forward_backward(x, model)
        gw = g[~np.isnan(x).any(axis=1)]
        mean = np.array([(gw[:, j] @ whole) / gw[:, j].sum() for j in range(k)])
        cov = np.array([(sum(gw[i, j] * np.outer(whole[i] - mean[j], whole[i] - mean[j]) for i in range(len(whole))) + H.PRIOR * np.eye(x.shape[1]))
                        / max(gw[:, j].sum(), 1.0) for j in range(k)])
        model = H.Model(g[0], moves / moves.sum(axis=1, keepdims=True), mean, cov)
        if log - before < tol:
            break
        before = log
    return model


def standardised(rows):
    x = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows], dtype=float)
    whole = ~np.isnan(x).any(axis=1)
    return (x - x[whole].mean(axis=0)) / x[whole].std(axis=0)


@pytest.fixture(scope="module")
def rows():
    return {"a": series(1, 120, "a", (5, 6, 50)), "b": series(2, 61, "b"), None: series(3, 43, None), "short": series(4, 9, "short")}


@pytest.mark.parametrize("block_rows, fan", [(7, 1024), (7, 3), (1000, 1024)])
def test_equals_a_plain_model(spark, rows, block_rows, fan, monkeypatch):
    """Seven-row blocks, combined in one or several levels, and whole series give the plain result."""
    monkeypatch.setattr(H, "FAN", fan)
    monkeypatch.setattr(H.scan, "__defaults__", (False, fan))
    df = spark.createDataFrame([r for rs in rows.values() for r in rs], SCHEMA)
    spec = SeriesSpec(keys=("series_id",), order="ts", block_rows=block_rows, bucket_seconds=20)
    got = {}
    for r in H.hidden_states(df, spec, COLS, 3, min_rows=20, max_iter=4, tol=1e-4).collect():
        got.setdefault(r["series_id"], {})[r["ts"]] = r
    for name, rs in rows.items():
        assert len(got[name]) == len(rs)
        out = [got[name][i] for i in range(len(rs))]
        if name == "short":
            assert all(r["fallback"] and r["state"] is None and r["volatile_prob"] == 0.5 and r["regime_0"] == 0.33 for r in out)
            continue
        x = standardised(rs)
        model = plain_fit(x, 3, 4, 1e-4)
        order = model.by_volatility
        want = plain_forward_backward(x, model)[0][:, order]
        missing = np.isnan(x).any(axis=1)
        have = np.array([[r[f"regime_{i}"] for i in range(3)] for r in out])
        assert np.abs(have - want)[~missing].max() < 1e-9
        assert [r["fallback"] for r in out] == missing.tolist()
        assert [r["volatile_prob"] for r in out] == [0.5 if m else h[2] for m, h in zip(missing, have)]
        assert [order[r["state"]] for r in out] == plain_path(x, model).tolist()


def test_a_long_series_is_spread(spark, rows):
    df = spark.createDataFrame(rows["a"], SCHEMA)
    spec = SeriesSpec(keys=("series_id",), order="ts", block_rows=7)
    blocks = H._blocks(H._rows(df, spec, COLS, 20))
    sizes = [len(r["z"]) // 2 for r in blocks.collect()]
    assert len(sizes) == 18 and max(sizes) == 7


def test_block_statistics_add_up():
    x = standardised(series(7, 100, "a", (10, 40)))
    model = plain_fit(x, 3, 2, 1e-4)
    g, moves, log = plain_forward_backward(x, model)
    s = H.statistics(x, True, model, np.ones(3), np.ones(3))
    assert np.allclose(s[0], log, atol=1e-9) and np.allclose(s[1:4], g[0], atol=1e-10) and np.allclose(s[4:13].reshape(3, 3), moves, atol=1e-9)


def test_collapse_falls_back_to_uniform(spark):
    """A constant series has one state."""
    df = spark.createDataFrame([("c", i, 1.0, 2.0) for i in range(60)], SCHEMA)
    spec = SeriesSpec(keys=("series_id",), order="ts")
    out = H.hidden_states(df, spec, COLS, 3, min_rows=20).collect()
    for r in out:
        assert abs(r["regime_0"] + r["regime_1"] + r["regime_2"] - 1) < 1e-9
        assert not np.isnan(r["volatile_prob"])
    one = spark.createDataFrame([("c", i, float(i), float(-i)) for i in range(60)], SCHEMA)
    out = H.hidden_states(one, spec, COLS, 1, min_rows=20).collect()
    assert all(r["fallback"] and r["regime_0"] == 1.0 and r["volatile_prob"] == 0.5 and r["state"] is None for r in out)


def test_path_feeds_the_stability(spark, rows):
    df = spark.createDataFrame(rows["a"] + rows["short"], SCHEMA)
    spec = SeriesSpec(keys=("series_id",), order="ts", block_rows=50)
    h = H.hidden_states(df, spec, COLS, 3, min_rows=20, max_iter=4)
    got = {r["series_id"]: r for r in regime_stability(h, spec, "state").collect()}
    states = [r["state"] for r in h.filter("series_id = 'a'").orderBy("ts").collect()]
    changes = sum(a != b for a, b in zip(states, states[1:]))
    assert got["a"]["state_changes"] == changes and got["short"]["state_changes"] == 0


def test_two_states(spark, rows):
    df = spark.createDataFrame(rows["a"] + rows["b"] + rows["short"], SCHEMA)
    spec = SeriesSpec(keys=("series_id",), order="ts")
    out = H.two_states(df, spec, COLS, max_iter=5).collect()
    for name in ("a", "b"):
        by = {}
        for r in out:
            if r["series_id"] == name:
                by.setdefault(r["state"], []).extend(v for v in (r["p"], r["t"]) if v is not None and not np.isnan(v))
        volatile = max(by, key=lambda s: (np.var(by[s]), -s))
        assert all(r["volatile"] == (r["state"] == volatile) for r in out if r["series_id"] == name)
    assert all(r["volatile_prob"] == 0.5 and r["volatile"] is None for r in out if r["series_id"] == "short")


def test_no_rows_and_no_whole_rows(spark):
    spec = SeriesSpec(keys=("series_id",), order="ts")
    assert H.hidden_states(spark.createDataFrame([], SCHEMA), spec, COLS).count() == 0
    df = spark.createDataFrame([("n", i, None, 1.0) for i in range(250)], SCHEMA)
    out = H.hidden_states(df, spec, COLS)
    assert out.count() == 250 and out.filter(F.col("fallback") & F.col("state").isNull()).count() == 250


def test_shares_without_a_look_ahead(spark, rows):
    """Fitted on the first rows, a row's shares don't change with what comes later."""
    spec = SeriesSpec(keys=("series_id",), order="ts", block_rows=7)
    late = [(n, i, (p or 0.0) * 3 + 7, t) if i >= 90 else (n, i, p, t) for n, i, p, t in rows["a"]]
    out = []
    for r in (rows["a"], late):
        df = spark.createDataFrame(r, SCHEMA).withColumn("fit", F.col("ts") < 80)
        got = H.hidden_states(df, spec, COLS, 3, min_rows=20, max_iter=3, fit_mask="fit", smooth=False).filter("ts < 90").orderBy("ts").collect()
        out.append([[x["regime_0"], x["regime_1"], x["regime_2"]] for x in got])
    assert np.allclose(out[0], out[1], atol=1e-12)
    x = standardised([(n, i, p if i < 80 else None, t) for n, i, p, t in rows["a"]])
    whole = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows["a"]], dtype=float)
    fit = whole[:80][~np.isnan(whole[:80]).any(axis=1)]
    z = (whole - fit.mean(axis=0)) / fit.std(axis=0)
    model = plain_fit(x, 3, 3, 1e-4)
    for t in (0, 30, 79):
        want = plain_forward_backward(z[:t + 1], model)[0][-1][model.by_volatility]
        assert np.allclose(out[0][t], want, atol=1e-9)

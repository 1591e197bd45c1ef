"""Nearest rows against brute force: clusters, remote points, ties, groups; recall in many dimensions."""

import numpy as np
import pytest

from cirro.operators import neighbours as N


def brute(points, refs, k, exclude_self=False):
    out = {}
    for pid, g, p in points:
        d = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(p, s)))), sid) for sid, h, s in refs if h == g and not (exclude_self and sid == pid))
        out[pid] = [(round(x, 9), sid) for x, sid in d[:k]]
    return {p: v for p, v in out.items() if v}


def frames(spark, points, refs, dim):
    fields = ", ".join
    P = spark.createDataFrame([(i, g, *map(float, p)) for i, g, p in points], f"pid long, pg string, {fields(f'p{j} double' for j in range(dim))}")
    S = spark.createDataFrame([(i, g, *map(float, p)) for i, g, p in refs], f"sid long, sg string, {fields(f's{j} double' for j in range(dim))}")
    return P, S


@pytest.mark.parametrize("dim", [1, 2, 3, 5])
def test_exact(spark, dim):
    """A dense cluster, spread rows, many rows at one place, a group without rows, a nameless group."""
    rng = np.random.default_rng(dim)
    refs = [(i, "a", rng.normal(size=dim) * 0.01 + 5) for i in range(300)] + [(1000 + i, "a", rng.uniform(-50, 50, dim)) for i in range(150)]
    refs += [(2000 + i, "a", np.full(dim, 7.0)) for i in range(120)] + [(3000 + i, None, rng.integers(0, 3, dim)) for i in range(80)] + [(4000, "b", np.zeros(dim))]
    points = [(i, "a", rng.uniform(-60, 60, dim)) for i in range(20)] + [(100, "a", np.full(dim, 4000.0)), (101, "a", np.full(dim, 7.0)), (102, None, np.ones(dim)),
                                                                         (103, "b", np.ones(dim)), (104, "none", np.ones(dim))]
    P, S = frames(spark, points, refs, dim)
    for k in (1, 6):
        got = {}
        for r in N.nearest(P, S, dim, k).collect():
            got.setdefault(r["pid"], []).append((r["rank"], (round(r["_d"], 9), r["sid"])))
        assert {p: [x for _, x in sorted(v)] for p, v in got.items()} == brute(points, refs, k)


def test_other_rows_only(spark):
    rng = np.random.default_rng(2)
    refs = [(i, "g", rng.integers(0, 4, 2)) for i in range(90)]
    P, S = frames(spark, refs, refs, 2)
    got = {}
    for r in N.nearest(P.drop("pg"), S.drop("sg"), 2, 3, exclude_self=True).collect():
        got.setdefault(r["pid"], []).append((r["rank"], (round(r["_d"], 9), r["sid"])))
    assert {p: [x for _, x in sorted(v)] for p, v in got.items()} == brute(refs, refs, 3, True)


def test_a_remote_point_meets_few_rows(spark, monkeypatch):
    """1,500 rows in a far cluster: the last join sees the cells that face the point."""
    rng = np.random.default_rng(3)
    refs = [(i, "a", rng.normal(size=2)) for i in range(1500)]
    P, S = frames(spark, [(1, "a", [1e4, 1e4])], refs, 2)
    kept = []
    real = N.cut_lineage

    def seen(df):
        out = real(df)
        if "gap" in out.columns:
            kept.append(out.agg({"n": "sum"}).first()[0])
        return out

    monkeypatch.setattr(N, "cut_lineage", seen)
    got = N.nearest(P, S, 2, 5).collect()
    assert len(got) == 5 and kept[-1] < 300


def test_no_rows(spark):
    P, S = frames(spark, [(1, "a", [0.0])], [(1, "a", [0.0])], 1)
    assert N.nearest(P, S.limit(0), 1, 2).count() == 0 and N.nearest(P.limit(0), S, 1, 2).count() == 0


def test_forest_recall_and_leaf_sizes(spark):
    """60 dimensions of which few matter, 3,000 rows, 300 of them equal."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2700, 4)) @ rng.normal(size=(4, 60)) + 0.05 * rng.normal(size=(2700, 60))
    x = np.vstack([x, np.repeat(x[:1], 300, axis=0)])
    cols = [f"c{i}" for i in range(60)]
    df = spark.createDataFrame([(f"r{i}", *map(float, v)) for i, v in enumerate(x)], ["id_", *cols])
    found = N.forest_neighbours(df, "id_", cols, 5, leaf=200).cache()
    assert found.groupBy("id_").count().filter("count <> 5").count() == 0 and found.filter("id_ = neighbour").count() == 0
    assert N.measured_recall(df, found, "id_", cols, 5, 150) >= 0.9
    r = found.filter("rank = 1").first()
    assert r["distance"] == pytest.approx(float(np.linalg.norm(x[int(r["id_"][1:])] - x[int(r["neighbour"][1:])])))


def test_forest_of_few_rows_is_exact(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 8))
    cols = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["i", *cols])
    got = {(r["i"], r["rank"]): r["neighbour"] for r in N.forest_neighbours(df, "i", cols, 3).collect()}
    for i in range(50):
        d = np.linalg.norm(x - x[i], axis=1)
        d[i] = np.inf
        assert [got[i, n + 1] for n in range(3)] == np.argsort(d)[:3].tolist()
    assert N.forest_neighbours(df.limit(1), "i", cols, 3).count() == 0

"""Points that walk together: few rows move, results as of single points."""

import numpy as np
import pytest

from cirro.operators import neighbours as N


@pytest.mark.parametrize("faced", [N.FACED, 60])
def test_points_walk_in_blocks(spark, monkeypatch, faced):
    """1,200 points and 900 rows; a pid that comes twice, two without one; with 60, blocks are taken apart again."""
    rng = np.random.default_rng(11)
    at = np.vstack([rng.normal(size=(900, 2)) * 0.05, rng.uniform(-3, 3, (298, 2)), [[9.0, 9.0], [-40.0, 2.0]]])
    ids = [*range(1197), 5, None, None]
    refs = np.vstack([rng.normal(size=(500, 2)) * 0.05, rng.uniform(-3, 3, (400, 2))])
    P = spark.createDataFrame([(i, *map(float, p)) for i, p in zip(ids, at)], "pid long, p0 double, p1 double")
    S = spark.createDataFrame([(f"s{i}", *map(float, p)) for i, p in enumerate(refs)], "sid string, s0 double, s1 double")
    monkeypatch.setattr(N, "FACED", faced)
    walked, real = [], N.cut_lineage

    def seen(df):
        out = real(df)
        if "gap" in out.columns:
            walked.append(out.count())
        return out

    monkeypatch.setattr(N, "cut_lineage", seen)
    got = {}
    for r in N.nearest(P, S, 2, 4).collect():
        got.setdefault(r["pid"], []).append((r["rank"], r["sid"], round(r["_d"], 9)))
    true = {}
    for i, p in zip(ids, at):
        true.setdefault(i, []).extend((float(np.sqrt(((p - s) ** 2).sum())), f"s{j}") for j, s in enumerate(refs))
    assert {p: sorted(v) for p, v in got.items()} == {p: [(n + 1, s, round(d, 9)) for n, (d, s) in enumerate(sorted(v)[:4])] for p, v in true.items()}
    if faced == N.FACED and faced > 60:
        assert walked[0] < 600                        # one row a block and cell; before: one a point


def test_one_place(spark):
    """400 points at one place are several blocks, none larger than the limit."""
    P = spark.createDataFrame([(i, 0, 1.0) for i in range(400)] + [(400, 1, 1.0), (401, None, 1.0)], "pid long, pg int, p0 double")
    sizes = {(r["pg"], r["block"]): r["count"] for r in N._blocks(P, 1, 1.0).groupBy("pg", "block").count().collect()}
    assert sum(sizes.values()) == 402 and max(sizes.values()) <= N.BLOCK and len({b for _, b in sizes}) == len(sizes) < 60

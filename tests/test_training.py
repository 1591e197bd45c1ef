"""The training plan: what each step sees, and the whole run with its scores."""

import pytest
from pyspark.sql import functions as F

from cirro.operators import programs as P
from cirro.plans import training as TR

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def prepared(spark):
    return TR.prepare(spark, SF)


def test_preparation_selects_and_scales_on_training_rows(prepared):
    data, cols = prepared
    assert 50 <= len(cols) <= 150 and len(set(cols)) == len(cols) and not any(c.startswith("regime_") for c in cols)
    train = data.filter("split = 'train'").groupBy("series_id").agg(*[F.percentile(c, 0.5).alias(c) for c in cols[:10]])
    assert all(abs(r[c]) < 1e-9 for r in train.collect() for c in cols[:10])
    assert data.filter(" OR ".join(f"`{c}` IS NULL OR isnan(`{c}`)" for c in cols)).count() == 0


def test_synthetic_rows_belong_to_one_set(prepared):
    data, cols = prepared
    rows, roles = TR.training_rows(data.filter("split = 'train'"), cols, 2)
    got = rows.select(TR.ROW, "label", *roles).collect()
    made = [r for r in got if ":" in r[TR.ROW].split("|")[0]]
    assert roles == ["_r0", "_r1", "_all"] and len({r[TR.ROW] for r in got}) == len(got)
    for r in made:
        assert sorted(r[x] for x in roles) == [0, 0, 1] and r[TR.ROW].startswith(next(x for x in roles if r[x] == 1) + ":")
    for role in roles:                                    # each set's training rows are balanced
        sizes = {}
        for r in got:
            if r[role] == P.TRAIN:
                sizes[r["label"]] = sizes.get(r["label"], 0) + 1
        assert len(sizes) == 2 and len(set(sizes.values())) == 1
    own = [r for r in got if r not in made]
    assert all(r["_all"] == P.TRAIN for r in own) and any(r["_r0"] == P.TEST for r in own) and not any(r[x] == P.TEST for r in made for x in roles)


def test_whole_run(spark):
    t = TR.train(spark, SF, kinds=["rf", "lgb", "lr"], n_iter=2, k_folds=2)
    assert set(t.models) == set(t.params) == {"rf", "lgb", "lr"} and t.kept and 0 <= t.ens_q <= 1
    met = {r["model"]: r for r in TR.test_metrics(t).collect()}
    n = t.data.filter("split = 'test'").count()
    assert set(met) == {"rf", "lgb", "lr", "ensemble"}
    for r in met.values():
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == n and 0 <= r["auc"] <= 1

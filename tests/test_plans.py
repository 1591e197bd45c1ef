"""Physical-plan properties: pruned scans, one Window node per feature
select, no cartesian products; mutual information against brute force."""

import math
import re
from collections import Counter

import numpy as np

from cirro.operators.joins import nearest_k
from cirro.operators.selection import mutual_information
from cirro.plans import views as V
from cirro.plans.features import feature_label

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_shape(spark):
    plan = _plan(feature_label(V.ev_hourly(spark, SF)))
    # every feature frame in one Window node partitioned by (series, block)
    feature_windows = [l for l in plan.splitlines() if "Window [" in l and "_blk" in l]
    assert len(feature_windows) == 1
    # scans read only the columns the query needs
    for scan in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert "user_id" not in scan and "event_id" not in scan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_knn_has_no_cartesian_product(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0)], "point_id long, lat double, lon double")
    st = spark.createDataFrame([("A", 1.0, 1.0), ("B", 9.0, 9.0), ("C", 50.0, 50.0)],
                               "station_id string, lat double, lon double")
    out = nearest_k(pts, st, 1, "degrees")
    plan = _plan(out)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert {(r["point_id"], r["station_id"]) for r in out.collect()} == {(1, "A"), (2, "B")}


def test_mutual_information_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=400)
    y = (x + rng.normal(size=400) * 0.5 > 0).astype(int)
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(x, y)], "grp string, f double, label int")
    got = mutual_information(df, ["grp"], ["f"], "label", 10).first()["mi"]
    lo, hi = x.min(), x.max()
    bins = np.minimum(np.floor((x - lo) / (hi - lo) * 10), 9).astype(int)
    joint = Counter(zip(bins, y))
    n = len(x)
    pb, py = Counter(bins), Counter(y)
    exp = sum(c / n * math.log(c * n / (pb[b] * py[t])) for (b, t), c in joint.items())
    assert abs(got - exp) < 1e-9


def test_latest_keeps_few_rows_before_the_shuffle(spark):
    from cirro.operators.splits import latest
    from cirro.plans import views as V
    df = latest(V.ev_raw(spark, SF), V.RAW_SPEC, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    partial = [line for line in plan.splitlines() if "WindowGroupLimit" in line and "Partial" in line]
    assert partial and plan.count("Scan parquet") == 1

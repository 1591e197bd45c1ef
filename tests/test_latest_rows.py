"""Rows that must come back: unlabelled newest rows, rows with missing observations, points without a report."""

import pytest
from pyspark.sql import functions as F

from cirro.operators import joins as J
from cirro.operators.fill import fill_with_stat
from cirro.operators.hidden_states import hidden_states
from cirro.plans.series import SeriesSpec

SF = "/root/testdata/sf0.001"


def test_regimes_return_every_row(spark):
    rows = [("a", i, 1000.0 + i % 7 * (1 + i % 3), 20.0 + i % 5, 50.0 + i % 11) for i in range(250)]
    rows[3] = ("a", 3, None, 20.0, 50.0)
    rows[4] = ("a", 4, float("nan"), 20.0, 50.0)
    rows += [("b", i, 1000.0, 20.0, 50.0) for i in range(5)] + [(None, i, 1000.0 + i, 20.0 + i, 50.0) for i in range(3)]
    df = spark.createDataFrame(rows, "series_id string, i int, pressure double, temperature double, humidity double")
    out = hidden_states(df, SeriesSpec(keys=("series_id",), order="i"), ["pressure", "temperature", "humidity"]).collect()
    assert len(out) == len(rows)
    uniform = {(r.series_id, r.i) for r in out if r.fallback}
    assert uniform == {("a", 3), ("a", 4)} | {("b", i) for i in range(5)} | {(None, i) for i in range(3)}
    for r in out:
        assert r.regime_0 + r.regime_1 + r.regime_2 == pytest.approx(1.0)
        assert not r.fallback or r.volatile_prob == 0.5


def test_regimes_of_no_rows(spark):
    df = spark.createDataFrame([], "series_id string, i int, p double")
    assert hidden_states(df, SeriesSpec(keys=("series_id",), order="i"), ["p"]).count() == 0


def test_points_without_report_come_back(spark):
    ranked = spark.createDataFrame([(1, "s", 1), (1, "t", 2), (2, "t", 1), (3, "u", 1)], "point_id int, station_id string, rank int")
    obs = spark.createDataFrame([("s", "metar", None), ("t", "metar", 2.0), ("t", "observation", 3.0)],
                                "station_id string, kind string, value double")
    out = {r.point_id: tuple(r)[1:] for r in J.first_reporting(ranked, obs, kinds=["observation", "metar"]).collect()}
    assert out == {1: ("t", 2, "observation", 3.0), 2: ("t", 1, "observation", 3.0), 3: (None, None, None, None)}


def test_mean_fill_uses_fit_rows_only(spark):
    df = spark.createDataFrame([("a", 0, 1.0, True), ("a", 1, None, True), ("a", 2, 9.0, False), ("b", 0, None, False)],
                               "series_id string, ts int, x double, fit boolean")
    spec = SeriesSpec(keys=("series_id",), order="ts")
    out = {(r.series_id, r.ts): r.x for r in fill_with_stat(df, spec, ["x"], "mean", 0.0, "fit").collect()}
    assert out == {("a", 0): 1.0, ("a", 1): 1.0, ("a", 2): 9.0, ("b", 0): 0.0}


def test_newest_row_is_scored(spark):
    from cirro.plans import training as TR
    from cirro.plans import views as V
    t = TR.train(spark, SF, kinds=["lr"], n_iter=1, k_folds=2)
    unlabelled = t.data.filter(F.col("label").isNull())
    assert {r.split for r in unlabelled.select("split").distinct().collect()} == {"score"}
    assert {r["count"] for r in unlabelled.groupBy("series_id").count().collect()} == {TR.HORIZON}
    newest = {r.series_id: r.ts for r in V.ev_weather(spark, SF).groupBy("series_id").agg(F.max("ts").alias("ts")).collect()}
    assert {r.series_id: r.ts for r in TR.score_latest(t).collect()} == newest

"""Cases in which wrong results were once seen."""

import datetime as dt

import pytest

from cirro.operators.sampling import _take_smallest
from cirro.operators.windows import drawdown
from cirro.plans.series import SeriesSpec


@pytest.mark.parametrize("m, n", [(16, 23), (14, 24), (16, 27), (1, 5), (5, 5), (0, 4), (9, 400)])
def test_take_smallest_gives_exactly_m_rows(spark, m, n):
    got = [r[0] for r in _take_smallest(spark.range(n), ["id"], m, 42).collect()]
    assert len(got) == len(set(got)) == m


def test_drawdown_reads_nan_as_zero(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=i), v) for i, v in enumerate([10.0, 8.0, float("nan"), 5.0, 9.0])]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, x double")
    got = [r["x_drawdown"] for r in drawdown(df, SeriesSpec(), ["x"]).orderBy("ts").collect()]
    assert got == pytest.approx([0, 0.2, 1, 0.5, 0.1])

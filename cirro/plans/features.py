"""Feature plans: the flagship ``feature_label`` slice.

hourly frame, lag 3, the six rolling statistics over 6 rows, and the
future label over the next ``FLAG_H`` rows -- all in one select, so one
Window node (one exchange, one sort) serves every column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cirro.operators.windows import future_label_col, lag_cols, rolling_cols
from cirro.plans.layout import run_windows, with_positions
from cirro.plans.series import SeriesSpec

# Fixed parameters of the flagship (label threshold on the hourly mean).
FLAG_H = 4
FLAG_THR = 200.0


def feature_label(hourly: DataFrame, spec: SeriesSpec | None = None,
                  value: str = "v_avg") -> DataFrame:
    spec = spec or SeriesSpec(keys=("series_id",), order="ts")

    def build(sw):
        return (lag_cols(sw, [value], [3])
                + rolling_cols(sw, [value], [6])
                + [(f"label_next_{FLAG_H}", future_label_col(sw, value, FLAG_H, FLAG_THR))])
    out = run_windows(hourly.select(*spec.keys, spec.order, value), spec, build,
                      lookback=5, lookahead=FLAG_H)
    return out


# --- the reference's full feature set (golden width: 211 new columns) -------------
def engineer_features(wx: DataFrame, spec: SeriesSpec | None = None, *, pca_k: int = 5,
                      fit_mask: str | None = None, compat_week: bool = True,
                      pca_exclude: tuple = ("label",)) -> DataFrame:
    """All derived features of the reference on an hourly weather frame
    (series_id, ts, temperature, humidity, pressure, precipitation,
    wind_speed, ...): lags 36, rolling 108, differences 15 + accelerations
    3, rain 21, interactions 2, spectral 6, correlations 3, calendar 9,
    hours since rain 1, tendency 2, PCA 5.

    Every window column is one expression in one ``select`` over the
    blocked layout (one Window node); the spectral block is its own
    windowed job; hours-since-rain carries across blocks.  Remaining gaps
    are filled forward (168 rows), then with the series mean, then 0; that
    mean and PCA are fitted on the rows where ``fit_mask`` is true (train
    rows, Q3) or on all rows when None.
    """
    from pyspark.sql import functions as F

    from cirro.functions.weather import calendar_parts, cyclic_time, interactions
    from cirro.operators.fill import fill_with_stat
    from cirro.operators.frames import trailing_frames
    from cirro.operators.spectrum import spectral_features
    from cirro.operators.windows import (
        FEATURE_DIFFS, FEATURE_LAGS, FEATURE_ROLLING, RAIN_WINDOWS, TENDENCY_HOURS,
        accel_cols, corr_frames, diff_cols, ffill_col, hours_since, rain_frames, rolling_frames)

    spec = spec or SeriesSpec(keys=("series_id",), order="ts")
    keys = list(spec.keys)
    base = wx.columns

    def build(sw):
        out = []
        out += lag_cols(sw, ["pressure", "temperature", "humidity", "wind_speed"], FEATURE_LAGS)
        out += diff_cols(sw, ["pressure", "humidity", "temperature"], FEATURE_DIFFS)
        out += accel_cols(sw, ["pressure", "humidity", "temperature"], 6)
        out += diff_cols(sw, ["pressure"], TENDENCY_HOURS, "tendency")
        return out
    from cirro.session import cut_lineage
    # Each stage below reads its input twice (position counts + rows, block
    # carries + rows, statistics + rows); checkpoints between the stages
    # keep the plan linear and let a lost executor restart from the last
    # stage instead of the scan.
    f = run_windows(with_positions(wx, spec), spec, build, lookback=168, positioned=True, keep_pos=True)
    f = trailing_frames(f, spec, [
        *rolling_frames(["pressure", "humidity", "temperature"], FEATURE_ROLLING), *rain_frames("precipitation", RAIN_WINDOWS),
        *corr_frames([("pressure", "temperature"), ("pressure", "humidity"), ("temperature", "humidity")])], positioned=True)
    f = f.select("*", *[e.alias(n) for n, e in interactions()],
                 *[e.alias(n) for n, e in calendar_parts(spec.order)],
                 *[e.alias(n) for n, e in cyclic_time(spec.order, compat_week=compat_week)])
    f = cut_lineage(f)
    f = hours_since(f, spec, "precipitation", 0.1, "hours_since_rain")
    sp = spectral_features(wx.select(*keys, *spec.order_cols, "pressure"), spec, "pressure")
    f = cut_lineage(f.join(sp.drop("pressure"), keys + spec.order_cols, "left"))
    derived = [c for c in f.columns if c not in base]
    # gap handling: forward fill (168 rows), series mean, 0
    from cirro.plans.layout import run_windows as rw
    ff = rw(f, spec, lambda sw: [(f"_ff_{c}", ffill_col(sw, c, 168)) for c in derived], lookback=168)
    ff = ff.select(*[F.col(f"_ff_{c}").alias(c) if c in derived else F.col(c)
                     for c in f.columns])
    ff = cut_lineage(fill_with_stat(cut_lineage(ff), spec, derived, "mean", 0.0, fit_mask))
    if pca_k:
        from cirro.operators.models import pca_features
        from cirro.operators.select import numeric_columns
        numeric = [c for c in numeric_columns(ff) if c not in keys + spec.order_cols + list(pca_exclude)]
        ff = pca_features(ff, numeric, pca_k, fit_mask=fit_mask)
    return ff

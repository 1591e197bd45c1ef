"""Row-frame window operators (partitioned by series, ordered by time).

Each ``*_cols`` function takes a ``SeriesWindow`` and returns a list of
``(name, Column)``; the DataFrame-level functions wrap them with
``run_windows`` (blocked layout, one Window node).  pandas ``rolling(n)``
counts rows, so frames are ``rowsBetween(-(n-1), 0)`` and
``min_periods=m`` becomes a gate on ``count(x)`` over the same frame.
Long frames, which Spark would work out anew for each row, go through
``operators.frames``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirro.functions.stats import col, finite_or, gated, kurt_unbiased, skew_unbiased
from cirro.operators.frames import Frame, trailing_frames
from cirro.plans.layout import run_windows, with_block_carries, with_block_carry, with_positions
from cirro.plans.series import POS, SeriesSpec, SeriesWindow

Named = list[tuple[str, Column]]

# Fixed values of the reference's feature set (hours == rows on an hourly grid).
FEATURE_LAGS = [1, 3, 6, 12, 24, 48, 72, 120, 168]
FEATURE_ROLLING = [6, 12, 24, 48, 72, 168]
FEATURE_DIFFS = [1, 3, 6, 12, 24]
RAIN_WINDOWS = [3, 6, 12, 24, 48, 72, 168]
PANEL_WINDOWS = [6, 12, 24, 48, 72, 168, 336, 720]
TENDENCY_HOURS = [6, 24]


def default_min_periods(n: int) -> int:
    return max(1, n // 4)


# --- W1 -------------------------------------------------------------------
def lag_cols(sw: SeriesWindow, cols: Iterable[str], lags: Sequence[int]) -> Named:
    return [(f"{c}_lag_{h}", sw.lag(c, h)) for c in cols for h in lags]


# --- W2-W6 ------------------------------------------------------------------
def rolling_cols(sw: SeriesWindow, cols: Iterable[str], windows: Sequence[int],
                 stats: Sequence[str] = ("mean", "std", "min", "max", "skew", "kurt"),
                 min_periods: int | None = None) -> Named:
    out: Named = []
    for c in cols:
        for n in windows:
            fr = sw.trailing(n)
            mp = default_min_periods(n) if min_periods is None else min_periods
            cnt = F.count(col(c)).over(fr)
            for s in stats:
                if s == "mean":
                    e = gated(F.avg(c).over(fr), cnt, mp)
                elif s == "std":
                    e = gated(F.stddev_samp(c).over(fr), cnt, mp)
                elif s == "min":
                    e = gated(F.min(c).over(fr), cnt, mp)
                elif s == "max":
                    e = gated(F.max(c).over(fr), cnt, mp)
                elif s == "sum":
                    e = gated(F.sum(c).over(fr), cnt, mp)
                elif s == "skew":
                    e = gated(skew_unbiased(c, fr), cnt, mp)
                elif s == "kurt":
                    e = gated(kurt_unbiased(c, fr), cnt, mp)
                else:
                    raise ValueError(s)
                out.append((f"{c}_{s}_{n}", e))
    return out


# --- W8 / W9 / W16 ----------------------------------------------------------
def diff_cols(sw: SeriesWindow, cols: Iterable[str], hours: Sequence[int],
              name: str = "diff") -> Named:
    return [(f"{c}_{name}_{h}", F.col(c) - sw.lag(c, h)) for c in cols for h in hours]


def accel_cols(sw: SeriesWindow, cols: Iterable[str], h: int) -> Named:
    """x(t) - 2 x(t-h) + x(t-2h), i.e. ``diff(h).diff(h)``."""
    return [(f"{c}_accel_{h}", F.col(c) - 2 * sw.lag(c, h) + sw.lag(c, 2 * h)) for c in cols]


# --- W15 ---------------------------------------------------------------------
def trend_cols(sw: SeriesWindow, cols: Iterable[str], windows: Sequence[int]) -> Named:
    return [(f"{c}_trend_{n}", F.col(c) - F.avg(c).over(sw.trailing(n)))
            for c in cols for n in windows]


# --- W17 ---------------------------------------------------------------------
def ffill_col(sw: SeriesWindow, c: str, limit: int) -> Column:
    return F.last(c, ignorenulls=True).over(sw.rows(-limit, 0))


def bfill_col(sw: SeriesWindow, c: str, limit: int) -> Column:
    return F.first(c, ignorenulls=True).over(sw.rows(0, limit))


# --- W19 / W20 -----------------------------------------------------------------
def future_label_col(sw: SeriesWindow, c: str, horizon: int, thr: float,
                     partial: bool = False) -> Column:
    """1 if the sum of the next ``horizon`` rows exceeds ``thr``.

    NULL when fewer than ``horizon`` future rows exist, unless ``partial``
    (then partial sums are used and only the very last row is NULL).
    """
    fr = sw.ahead(horizon)
    s = F.sum(c).over(fr)
    n = F.count(F.lit(1)).over(fr)
    lab = F.when(F.coalesce(s, F.lit(0.0)) > thr, 1).otherwise(0)
    need = 1 if partial else horizon
    return F.when(n >= need, lab).cast("int")


def future_point_label_col(sw: SeriesWindow, c: str, h: int = 6, thr: float = 0.1) -> Column:
    return F.coalesce(sw.lead(c, h) > thr, F.lit(False)).cast("int")


# --- DataFrame-level wrappers ---------------------------------------------------
def lags(df: DataFrame, spec: SeriesSpec, cols, lags_=FEATURE_LAGS) -> DataFrame:
    return run_windows(df, spec, lambda sw: lag_cols(sw, cols, lags_), lookback=max(lags_))


def rolling_frames(cols: Iterable[str], windows: Sequence[int], stats: Sequence[str] = ("mean", "std", "min", "max", "skew", "kurt"),
                   min_periods: int | None = None) -> list[Frame]:
    return [Frame(f"{c}_{s}_{n}", s, c, n, default_min_periods(n) if min_periods is None else min_periods)
            for c in cols for n in windows for s in stats]


def rain_frames(c: str, windows: Sequence[int], prefix: str = "rain") -> list[Frame]:
    return [Frame(f"{prefix}_{s}_{n}", s, c, n) for n in windows for s in ("sum", "max", "std")]


def corr_frames(pairs, n: int = 72) -> list[Frame]:
    """Pearson correlation over n rows; needs n complete pairs."""
    return [Frame(f"corr_{x}_{y}_{n}", "corr", x, n, n, y) for x, y in pairs]


def rolling(df: DataFrame, spec: SeriesSpec, cols, windows=FEATURE_ROLLING,
            stats=("mean", "std", "min", "max", "skew", "kurt"), min_periods=None) -> DataFrame:
    return trailing_frames(df, spec, rolling_frames(cols, windows, stats, min_periods))


def diffs(df: DataFrame, spec: SeriesSpec, cols, hours=FEATURE_DIFFS, name="diff") -> DataFrame:
    return run_windows(df, spec, lambda sw: diff_cols(sw, cols, hours, name), lookback=max(hours))


def acceleration(df: DataFrame, spec: SeriesSpec, cols, h: int = 6) -> DataFrame:
    return run_windows(df, spec, lambda sw: accel_cols(sw, cols, h), lookback=2 * h)


def rain_totals(df: DataFrame, spec: SeriesSpec, c: str, windows=RAIN_WINDOWS,
                prefix: str = "rain") -> DataFrame:
    return trailing_frames(df, spec, rain_frames(c, windows, prefix))


def _panel(df: DataFrame, spec: SeriesSpec, frames: Sequence[Frame], keep_pos: bool = False) -> DataFrame:
    """Frames only where the series is longer than the window (else NULL: the statistic is absent); none there: 0."""
    out = trailing_frames(_with_length(df, spec), spec, frames, positioned=True, keep_pos=keep_pos)
    return out.select(*df.columns, *([POS] if keep_pos else []), *[F.when(F.col("_len") > f.n, F.coalesce(f.name, F.lit(0.0))).alias(f.name) for f in frames])


def rolling_panel(df: DataFrame, spec: SeriesSpec, cols, windows=PANEL_WINDOWS,
                  stats=("mean", "std", "min", "max"), keep_pos: bool = False) -> DataFrame:
    """Dashboard rolling panel: min_periods 1, NaN -> 0."""
    return _panel(df, spec, rolling_frames(cols, windows, stats, 1), keep_pos)


def accumulations(df: DataFrame, spec: SeriesSpec, c: str, windows=PANEL_WINDOWS) -> DataFrame:
    return _panel(df, spec, [Frame(f"{name}_{n}", s, c, n) for n in windows for name, s in (("acc", "sum"), ("max", "max"))])


def rolling_corr(df: DataFrame, spec: SeriesSpec, pairs, n: int = 72) -> DataFrame:
    return trailing_frames(df, spec, corr_frames(pairs, n))


def trend(df: DataFrame, spec: SeriesSpec, cols, windows=(3, 6, 12, 24)) -> DataFrame:
    return run_windows(df, spec, lambda sw: trend_cols(sw, cols, windows), lookback=max(windows) - 1)


def ffill(df: DataFrame, spec: SeriesSpec, cols, limit: int = 168) -> DataFrame:
    res = run_windows(df, spec, lambda sw: [(f"_f_{c}", ffill_col(sw, c, limit)) for c in cols],
                      lookback=limit)
    return _replace(res, cols, "_f_")


def bfill(df: DataFrame, spec: SeriesSpec, cols, limit: int = 168) -> DataFrame:
    res = run_windows(df, spec, lambda sw: [(f"_f_{c}", bfill_col(sw, c, limit)) for c in cols],
                      lookahead=limit)
    return _replace(res, cols, "_f_")


def future_label(df: DataFrame, spec: SeriesSpec, c: str, horizon: int, thr: float = 0.2,
                 partial: bool = False, name: str | None = None) -> DataFrame:
    name = name or f"label_next_{horizon}"
    return run_windows(df, spec, lambda sw: [(name, future_label_col(sw, c, horizon, thr, partial))],
                       lookahead=horizon)


def future_point_label(df: DataFrame, spec: SeriesSpec, c: str, h: int = 6, thr: float = 0.1,
                       name: str | None = None) -> DataFrame:
    name = name or f"label_at_{h}"
    return run_windows(df, spec, lambda sw: [(name, future_point_label_col(sw, c, h, thr))],
                       lookahead=h)


def _replace(df: DataFrame, cols, prefix: str) -> DataFrame:
    sel = [F.col(f"{prefix}{c}").alias(c) if c in cols else F.col(c)
           for c in df.columns if not c.startswith(prefix)]
    return df.select(*sel)


def _with_length(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Positions plus the series length ``_len``."""
    return with_positions(df, spec, length="_len")


# --- W13 ---------------------------------------------------------------------
def hours_since(df: DataFrame, spec: SeriesSpec, c: str, thr: float = 0.1,
                name: str = "hours_since_event") -> DataFrame:
    """Rows since the last row with ``c > thr``; 0 on event rows; before the
    first event the count runs 1, 2, 3, ... (the reference's loop).

    Gaps-and-islands as a running max of the last event position, with a
    carry across blocks so very long series stay split.
    """
    flag = F.coalesce(F.col(c) > thr, F.lit(False))
    pos = with_positions(df, spec)
    pos = with_block_carry(pos, spec, F.max(F.when(flag, F.col(POS))), "max", "_carry")

    def build(sw):
        last_in_blk = F.max(F.when(flag, F.col(POS))).over(sw.running())
        last = F.greatest(last_in_blk, F.col("_carry"))
        return [(name, (F.col(POS) - F.coalesce(last, F.lit(0))).cast("long"))]
    return run_windows(pos, spec, build, positioned=True).drop("_carry")


# --- W14 ---------------------------------------------------------------------
def drawdown(df: DataFrame, spec: SeriesSpec, cols, eps: float = 1e-10) -> DataFrame:
    """(peak - x) / (peak + eps) clamped to [0, 1]; NULL and non-finite values read as 0;
    peak is the running max from the first row."""
    pos = with_positions(df, spec)
    pos = with_block_carries(pos, spec, [(F.max(F.coalesce(finite_or(c, 0.0), F.lit(0.0))), "max", f"_pk_{c}", False)
                                         for c in cols])

    def build(sw):
        out = []
        for c in cols:
            x = F.coalesce(finite_or(c, 0.0), F.lit(0.0))
            peak = F.greatest(F.max(x).over(sw.running()), F.col(f"_pk_{c}"))
            dd = (peak - x) / (peak + eps)
            out.append((f"{c}_drawdown", F.greatest(F.lit(0.0), F.least(F.lit(1.0), dd))))
        return out
    return run_windows(pos, spec, build, positioned=True).drop(*[f"_pk_{c}" for c in cols])

"""Column-level statistics helpers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-10


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gated(expr: Column, n: Column, min_n: int) -> Column:
    """pandas ``min_periods``: NULL unless ``n >= min_n`` valid values."""
    return F.when(n >= min_n, expr)


def skew_unbiased(x: str | Column, frame) -> Column:
    """Bias-corrected sample skewness over a window frame (pandas).

    Spark's ``skewness`` is the population moment g1; the adjusted
    estimator is g1 * sqrt(n(n-1)) / (n-2), defined for n >= 3.  A
    constant window (second moment exactly 0, for which Spark returns
    NULL) gives 0.0, as pandas' rolling skew does.
    """
    n = F.count(col(x)).over(frame)
    g1 = F.skewness(col(x)).over(frame)
    adj = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.coalesce(F.nanvl(adj, F.lit(0.0)), F.lit(0.0)))


def kurt_unbiased(x: str | Column, frame) -> Column:
    """Bias-corrected excess kurtosis over a frame, n >= 4.  A constant
    window gives -3.0, as pandas' rolling kurt does."""
    n = F.count(col(x)).over(frame)
    g2 = F.kurtosis(col(x)).over(frame)
    adj = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.coalesce(F.nanvl(adj, F.lit(-3.0)), F.lit(-3.0)))


def skew_unbiased_agg(x: str | Column) -> Column:
    n = F.count(col(x))
    return F.when(n >= 3, F.skewness(col(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_unbiased_agg(x: str | Column) -> Column:
    n = F.count(col(x))
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(x)) + 6))


def finite_or(x: str | Column, default) -> Column:
    """NaN and +/-inf become ``default`` (F4 sanitize for one column)."""
    c = col(x)
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(bad, d).otherwise(c)


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b with 0/0 (and x/0) -> default, as sklearn's zero_division."""
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def round_doubles(df: DataFrame, digits: int = 6, overrides: dict | None = None) -> DataFrame:
    """Round every DOUBLE column for stable cross-engine comparison.

    1e-9 is added first so exact decimal ties round the same way in
    every engine.  ``overrides`` maps column -> digits.
    """
    overrides = overrides or {}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = overrides.get(f.name, digits)
            out.append(F.round(F.col(f.name).cast("double") + F.lit(1e-9), d).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def safe_corr(x: str | Column, y: str | Column, over=None) -> Column:
    """Pearson correlation over complete pairs, NULL when either side is
    constant.  Spark's ``corr`` divides by zero for a constant input,
    which raises under ANSI mode; covariance / (std * std) of the paired
    values is guarded instead."""
    xc, yc = col(x), col(y)
    both = xc.isNotNull() & yc.isNotNull()
    xp, yp = F.when(both, xc), F.when(both, yc)

    def agg(e):
        return e.over(over) if over is not None else e
    cov = agg(F.covar_samp(xp, yp))
    sx, sy = agg(F.stddev_samp(xp)), agg(F.stddev_samp(yp))
    return F.when((sx > 0) & (sy > 0), cov / (sx * sy))

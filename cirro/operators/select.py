"""Projections and filters.

Filters are plain ``filter`` expressions on the time column so Catalyst
pushes them into the Parquet scan; column choices are resolved from the
schema at plan time (Spark needs a fixed width).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def lookback(df: DataFrame, now: str, days: int = 62, ts: str = "ts") -> DataFrame:
    """rows with midnight(now - days) <= ts <= now; ``now`` is a parameter."""
    now_c = F.lit(now).cast("timestamp_ntz")
    start = F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
    start = F.make_timestamp_ntz(F.year(start), F.month(start), F.dayofmonth(start),
                                 F.lit(0), F.lit(0), F.lit(0))
    return df.filter((F.col(ts) >= start) & (F.col(ts) <= now_c))


def time_range(df: DataFrame, keys: Sequence[str], days: int, ts: str = "ts") -> DataFrame:
    """the last ``days`` days of every series (ts > max(ts) - days)."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last"))
    return (df.join(last, list(keys))
            .filter(F.col(ts) > F.col("_last") - F.make_interval(days=F.lit(days))).drop("_last"))


def numeric_columns(df: DataFrame) -> list[str]:
    """F5."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def feature_columns(df: DataFrame, target: str, exclude: Sequence[str] = ("precipitation",),
                    keep: Sequence[str] = ("volatile_prob",)) -> list[str]:
    """every numeric column except the excluded ones, the target and
    ``regime_*`` columns (``volatile_prob`` stays)."""
    out = []
    for c in numeric_columns(df):
        if c == target or c in exclude:
            continue
        if c.startswith("regime_") and c not in keep:
            continue
        out.append(c)
    return out


def align_features(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """the model's columns in its order; absent ones as 0; extras dropped."""
    have = set(df.columns)
    return df.select(*keep, *[(F.col(c) if c in have else F.lit(0.0)).alias(c) for c in cols])

"""Sinks and exports.

Output folders live under the session's checkpoint folder by default
(the shared folder a cluster names in ``spark.checkpoint.dir``); pass an
explicit path in production.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirro.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/cirro-out/{name}-{uuid.uuid4().hex}"


def write_series(df: DataFrame, path: str, keys: Sequence[str] = ("series_id",), fmt: str = "parquet",
                 mode: str = "overwrite") -> None:
    """The hourly table, one folder per series (partition pruning on read)."""
    w = df.write.mode(mode).partitionBy(*keys)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def append_forecasts(records: DataFrame, path: str) -> None:
    """Append forecast records (an append-only table)."""
    records.write.mode("append").parquet(path)


def export_rolling_long(panel: DataFrame, keys: Sequence[str], order: Sequence[str], stat_cols: Sequence[str],
                        pos: str = "_pos") -> DataFrame:
    """Rolling statistics as (variable, statistic, index, value);
    column names are ``<variable>_<stat>_<window>``; absent values dropped."""
    long = panel.unpivot([*keys, *order, pos], list(stat_cols), "_name", "value")
    parts = F.split("_name", "_")
    n = F.size(parts)
    variable = F.array_join(F.slice(parts, 1, n - 2), "_")
    statistic = F.concat(F.element_at(parts, -2), F.lit("_"), F.element_at(parts, -1), F.lit("h"))
    return long.filter(F.col("value").isNotNull()).select(
        *keys, variable.alias("variable"), statistic.alias("statistic"), (F.col(pos) - 1).alias("idx"), "value")


def export_matrix(long: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """The long (var_i, var_j, value) matrix as a square table."""
    return long.groupBy(*keys, "var_i").pivot("var_j", list(variables)).agg(F.first("value"))

"""Per-series aggregates.

All are ``groupBy(series).agg(...)`` (partial + final aggregation, so a
hot series is pre-aggregated on every map task before the shuffle) or a
window step followed by such an aggregate.  Multi-column statistics
(covariance, correlation) are computed for every pair in one ``agg``, or, of many
columns, as matrix products.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.functions.stats import finite_or, safe_corr
from cirro.operators.windows import drawdown as drawdown_op
from cirro.plans.layout import run_windows
from cirro.plans.series import SeriesSpec
from cirro.session import cut_lineage

EPS = 1e-10


def missing_profile(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """A1: null cells, total cells and percent missing per group."""
    nulls = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    return (df.groupBy(*keys)
            .agg(F.sum(nulls).alias("null_cells"), (F.count(F.lit(1)) * len(cols)).alias("total_cells"))
            .withColumn("missing_pct", F.col("null_cells") * 100.0 / F.col("total_cells")))


def data_quality(before: DataFrame, after: DataFrame, keys: Sequence[str],
                 cols: Sequence[str]) -> DataFrame:
    """A2: 1 - missing/total measured before and after imputation (Q4)."""
    b = missing_profile(before, keys, cols).select(
        *keys, (1 - F.col("null_cells") / F.col("total_cells")).alias("quality_before"))
    a = missing_profile(after, keys, cols).select(
        *keys, (1 - F.col("null_cells") / F.col("total_cells")).alias("quality_after"))
    return b.join(a, list(keys), "full")


def series_summary(df: DataFrame, spec: SeriesSpec, value: str, thr: float) -> DataFrame:
    """A3: rows, first/last time, event count and the latest value."""
    last_key = F.struct(*[F.col(c) for c in spec.order_cols])
    return df.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(spec.order).alias("first_ts"), F.max(spec.order).alias("last_ts"),
        F.count_if(F.col(value) > thr).alias("n_events"),
        F.max_by(value, last_key).alias("last_value"))


def class_balance(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """A4: totals, positives, percent positive."""
    return (df.filter(F.col(target).isNotNull()).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("total"), F.sum(target).cast("long").alias("positives"))
            .withColumn("positive_pct", F.col("positives") * 100.0 / F.col("total")))


WIDE = 30             # columns beyond which pairs are worked out as matrices


def pair_stats_long(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                    kind: str = "cov") -> DataFrame:
    """Sample covariance or Pearson correlation of every column
    pair over the rows that have both, NaN/NULL -> 0, as a long table
    (var_i, var_j, value) -- both orders of every pair, like the square matrix.
    Few columns are one aggregate; more than ``WIDE`` go through ``co_moments``."""
    if len(cols) > WIDE:
        return _wide_pair_stats(df, keys, cols, kind)
    fn = F.covar_samp if kind == "cov" else safe_corr
    pairs = list(combinations_with_replacement(cols, 2))
    aggs = [fn(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_p{i}")
            for i, (a, b) in enumerate(pairs)]
    wide = df.groupBy(*keys).agg(*aggs)
    entries = []
    for i, (a, b) in enumerate(pairs):
        v = F.coalesce(F.nanvl(F.col(f"_p{i}"), F.lit(0.0)), F.lit(0.0))
        entries.append(F.struct(F.lit(a).alias("var_i"), F.lit(b).alias("var_j"), v.alias("value")))
        if a != b:
            entries.append(F.struct(F.lit(b).alias("var_i"), F.lit(a).alias("var_j"), v.alias("value")))
    return wide.select(*keys, F.inline(F.array(*entries)))


def _batch_moments(x: np.ndarray) -> np.ndarray:
    """4 x D x D: per pair (i, j) of columns, over the rows that have both: count, mean of i, sum of squares of i
    and of products of i and j, both around their means.  NULL and NaN are NaN here."""
    here = ~np.isnan(x)
    centre = np.where(here.any(axis=0), np.where(here, x, 0.0).sum(axis=0) / np.maximum(here.sum(axis=0), 1), 0.0)
    z, m = np.where(here, x - centre, 0.0), here.astype(float)
    n, s = m.T @ m, z.T @ m
    safe = np.maximum(n, 1.0)
    return np.stack([n, centre[:, None] + s / safe, (z * z).T @ m - s * s / safe, z.T @ z - s * s.T / safe])


def _merged_moments(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None:
        return b
    n = a[0] + b[0]
    d = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    safe, both = np.maximum(n, 1.0), a[0] * b[0]
    mean = np.where(a[0] > 0, a[1], b[1]) + d * b[0] / safe
    return np.stack([n, mean, a[2] + b[2] + d * d * both / safe, a[3] + b[3] + d * d.T * both / safe])


def co_moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str], rows_per_task: int = 1 << 20, fan: int = 64) -> DataFrame:
    """(_sid, m): per series (all keys as a struct) the pair moments of all columns as doubles.

    Rows are dealt by (series, hash), at most about ``rows_per_task`` of a series together, and
    sorted by series; a task multiplies each batch's centred columns with themselves and merges the
    products.  Partial results are merged in a tree, ``fan`` in one task.
    """
    d = len(cols)
    numbers = [F.col(c).cast("double") for c in cols]
    x = df.select(F.struct(*keys).alias("_sid") if keys else F.struct(F.lit(0).alias("all")).alias("_sid"), F.array(*numbers).alias("x"))
    most = x.groupBy("_sid").count().agg(F.max("count")).first()[0] or 0
    dealt = x.withColumn("_salt", F.pmod(F.xxhash64("x"), F.lit(-(-most // rows_per_task) or 1)))
    dealt = dealt.repartition("_sid", "_salt").sortWithinPartitions("_sid", "_salt")
    sid = x.schema["_sid"].dataType.simpleString()

    def products(batches):
        now, held = None, None

        def out():
            return pa.RecordBatch.from_arrays([now[0], now[1], pa.array([held.ravel()], pa.list_(pa.float64()))], names=["_sid", "part", "m"])

        for batch in batches:
            ids = batch.column("_sid").to_pylist()
            salts = batch.column("_salt").to_pylist()
            cut = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1] or salts[i] != salts[i - 1]), len(ids)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                key = (ids[a], salts[a])
                if now is not None and key != now[2]:
                    yield out()
                    held = None
                now = (batch.column("_sid").slice(a, 1), batch.column("_salt").slice(a, 1), key)
                v = batch.column("x").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                held = _merged_moments(held, _batch_moments(v))
        if held is not None:
            yield out()

    def merged(t: pa.Table) -> pa.Table:
        held = None
        for m in t["m"]:
            held = _merged_moments(held, np.asarray(m.values).reshape(4, d, d))
        return pa.table([t["_sid"].slice(0, 1), pa.chunked_array([pa.array([t["part"][0].as_py() // fan], pa.int64())]), pa.array([held.ravel()], pa.list_(pa.float64()))], names=["_sid", "part", "m"])

    schema = f"_sid {sid}, part long, m array<double>"
    parts = cut_lineage(dealt.mapInArrow(products, schema))
    left = parts.agg(F.max("part")).first()[0] or 0
    while True:
        parts = parts.groupBy("_sid", F.floor(F.col("part") / fan).alias("_up")).applyInArrow(merged, schema)
        if left < fan:
            return parts.select("_sid", "m")
        left //= fan


def _wide_pair_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str], kind: str) -> DataFrame:
    keys, cols, d = list(keys), list(cols), len(cols)
    m = cut_lineage(co_moments(df, keys, cols))
    at = F.col("_i") * d + F.col("_j")
    back = F.col("_j") * d + F.col("_i")

    def cell(block, where):
        return F.col("m")[(block * d * d + where).cast("int")]
    n, xx, yy, xy = cell(0, at), cell(2, at), cell(2, back), cell(3, at)
    value = F.when(n > 1, xy / (n - 1)) if kind == "cov" else F.when((n > 1) & (xx > 0) & (yy > 0), xy / F.sqrt(xx * yy))
    names = F.array(*[F.lit(c) for c in cols])
    pairs = m.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(d - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    return pairs.select(*[F.col(f"_sid.{k}").alias(k) for k in keys], names[F.col("_i")].alias("var_i"), names[F.col("_j")].alias("var_j"),
                        F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).alias("value"))


def _returns(df: DataFrame, spec: SeriesSpec, value: str) -> DataFrame:
    """r = (x - prev)/(prev + 1e-10) with NaN/NULL read as 0 and non-finite
    results -> 0; the first row has no return (NULL)."""
    def build(sw):
        x, prev = (F.coalesce(finite_or(v, 0.0), F.lit(0.0)) for v in (F.col(value), sw.lag(value, 1)))
        has_prev = F.lag(F.lit(1), 1).over(sw.w).isNotNull()
        r = F.when(has_prev, finite_or((x - prev) / (prev + EPS), 0.0))
        return [("_r", r)]
    return run_windows(df.select(*spec.keys, *spec.order_cols, value), spec, build, lookback=1)


def return_stats(df: DataFrame, spec: SeriesSpec, value: str, rf: float = 0.01) -> DataFrame:
    """A7 + A8: volatility = population std of returns; Sharpe =
    mean(r - rf/n) / std_pop(r), 0 when n < 2 or std <= 1e-10 (n = rows)."""
    r = _returns(df, spec, value)
    g = r.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_r").alias("mean_return"),
        F.stddev_pop("_r").alias("_sd"))
    sd = F.coalesce(F.col("_sd"), F.lit(0.0))
    sharpe = F.when((F.col("n") >= 2) & (sd > EPS),
                    (F.col("mean_return") - rf / F.col("n")) / sd).otherwise(F.lit(0.0))
    return g.select(*spec.keys, "n", F.coalesce("mean_return", F.lit(0.0)).alias("mean_return"),
                    sd.alias("volatility"), sharpe.alias("sharpe"))


def max_drawdown(df: DataFrame, spec: SeriesSpec, value: str) -> DataFrame:
    """Maximum and current (latest) drawdown per series."""
    d = drawdown_op(df.select(*spec.keys, *spec.order_cols, value), spec, [value])
    dd = f"{value}_drawdown"
    last_key = F.struct(*[F.col(c) for c in spec.order_cols])
    return d.groupBy(*spec.keys).agg(F.max(dd).alias("max_drawdown"),
                                     F.max_by(dd, last_key).alias("current_drawdown"))


def ensemble_spread(df: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    """Spread of the model probabilities of one prediction.  Groups
    hold one row per model, so exact ``percentile`` is bounded here."""
    return df.groupBy(*keys).agg(
        F.min(p).alias("p_min"), F.max(p).alias("p_max"),
        F.percentile(p, 0.25).alias("p25"), F.percentile(p, 0.5).alias("p50"),
        F.percentile(p, 0.75).alias("p75"), F.avg(p).alias("p_mean"),
        F.stddev_pop(p).alias("p_std"), (F.max(p) - F.min(p)).alias("p_range"),
        F.count(p).alias("n_models"))


def ensemble_moments(df: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    """Mean, population std, population skewness (n>2) and excess
    kurtosis (n>3) over the models; undefined moments of a constant -> NULL."""
    n = F.count(p)
    return df.groupBy(*keys).agg(
        F.avg(p).alias("p_mean"), F.stddev_pop(p).alias("p_std"),
        F.when((n > 2) & (F.max(p) > F.min(p)), F.skewness(p)).alias("p_skew"),
        F.when((n > 3) & (F.max(p) > F.min(p)), F.kurtosis(p)).alias("p_kurt"))


def class_weights(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """A19: 'balanced' weight n / (2 * n_class) for each (group, class)."""
    g = df.filter(F.col(target).isNotNull()).groupBy(*keys, target).agg(F.count(F.lit(1)).alias("n_class"))
    tot = g.groupBy(*keys).agg(F.sum("n_class").alias("n"))
    return g.join(tot, list(keys)).select(*keys, target, "n_class",
                                          (F.col("n") / (2.0 * F.col("n_class"))).alias("weight"))


def daily_distribution(df: DataFrame, spec: SeriesSpec, value: str,
                       edges: Sequence[float]) -> DataFrame:
    """Daily totals binned by ``edges`` (last bin open), share of days."""
    day = F.to_date(spec.order)
    daily = df.groupBy(*spec.keys, day.alias("day")).agg(F.sum(value).alias("total"))
    upper = F.array(*[F.lit(float(e)) for e in edges[1:]])
    b = F.size(F.filter(upper, lambda e: e <= F.col("total")))
    binned = daily.withColumn("bin", b.cast("int"))
    counts = binned.groupBy(*spec.keys, "bin").agg(F.count(F.lit(1)).alias("days"))
    tot = binned.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("_all"))
    lo = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("bin") + 1)
    return (counts.join(tot, list(spec.keys))
            .select(*spec.keys, "bin", lo.alias("bin_low"), "days",
                    (F.col("days") * 100.0 / F.col("_all")).alias("pct_days")))


def regime_stability(df: DataFrame, spec: SeriesSpec, state: str) -> DataFrame:
    """1 - (number of state changes) / rows."""
    ch = run_windows(df.select(*spec.keys, *spec.order_cols, state), spec,
                     lambda sw: [("_chg", F.coalesce((F.col(state) != sw.lag(state, 1)).cast("int"),
                                                     F.lit(0)))], lookback=1)
    return ch.groupBy(*spec.keys).agg(
        F.sum("_chg").cast("long").alias("state_changes"), F.count(F.lit(1)).alias("n"),
        (1 - F.sum("_chg") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("stability"))

"""Rolling spectrum (W24, W25, T2) and rescaled-range Hurst exponent.

Windows: the reference evaluates, at every ``step``-th row i from row n
on, the n rows *before* i.  Each row belongs to at most n/step windows;
rows are exploded to their windows (with their offset t inside the
window), and each window is collected into one array of exactly n values
-- a group bounded by n, whatever the series length.  The amplitude
spectrum is then computed per window either

* in bulk (``method='fft'``, the default): an Arrow-batched Pandas UDF
  stacks the windows of a batch into a matrix and calls
  ``numpy.fft.fft`` once; or
* JVM-side (``method='basis'``): |sum_t x_t e^{-2 pi i k t / n}| with
  ``aggregate`` over the array -- no Python, but O(n^2) interpreted
  lambda steps per window (measured ~40x slower; kept as a cross-check).

Both give the de-meaned |DFT| of bins 0 .. n/2-1.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirro.operators.splits import latest
from cirro.operators.windows import _with_length
from cirro.plans.series import POS, SeriesSpec


def window_arrays(df: DataFrame, spec: SeriesSpec, value: str, n: int = 168, step: int = 24) -> DataFrame:
    """One row per window: keys, ``win`` (index), ``anchor_pos`` (1-based
    position of row i), ``xs`` (the n values before row i, in order)."""
    keys = list(spec.keys)
    d = _with_length(df.select(*keys, *spec.order_cols, value), spec)
    j0 = F.col(POS) - 1                                  # 0-based row index
    a_lo = F.greatest(F.lit(0), F.ceil((j0 + 1 - n) / step))
    a_hi = F.floor(j0 / step)
    # anchor row i = n + a*step must exist (i <= len-1)
    a_max = F.floor((F.col("_len") - 1 - n) / step)
    a_hi = F.least(a_hi, a_max)
    ex = d.filter(a_hi >= a_lo).select(*keys, value, j0.alias("_j"),
                                       F.explode(F.sequence(a_lo.cast("long"), a_hi.cast("long"))).alias("win"))
    ex = ex.withColumn("_t", F.col("_j") - F.col("win") * step)
    g = ex.groupBy(*keys, "win").agg(F.sort_array(F.collect_list(F.struct("_t", F.col(value).alias("_x")))).alias("_a"))
    return g.select(*keys, "win", (F.col("win") * step + n + 1).alias("anchor_pos"),
                    F.transform("_a", lambda s: s["_x"]).alias("xs"))


def amplitudes_basis(xs: Column, n: int) -> Column:
    """|DFT| of the de-meaned window, bins 0 .. n/2-1, as JVM expressions."""
    mean = F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x) / n
    dm = F.transform(xs, lambda x: x - mean)
    idx = F.arrays_zip(F.sequence(F.lit(0), F.lit(n - 1)).alias("t"), dm.alias("v"))
    w = 2 * math.pi / n

    def amp(k):
        re = F.aggregate(idx, F.lit(0.0), lambda acc, e: acc + e["v"] * F.cos(w * k * e["t"]))
        im = F.aggregate(idx, F.lit(0.0), lambda acc, e: acc + e["v"] * F.sin(w * k * e["t"]))
        return F.sqrt(re * re + im * im)
    return F.transform(F.sequence(F.lit(0), F.lit(n // 2 - 1)), amp)


def _fft_udf(n: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def fft_amp(col: pd.Series) -> pd.Series:
        if len(col) == 0:
            return pd.Series([], dtype=object)
        m = np.stack([np.asarray(v, dtype=float) for v in col])
        m = m - m.mean(axis=1, keepdims=True)
        a = np.abs(np.fft.fft(m, axis=1))[:, : n // 2]
        return pd.Series(list(a))
    return fft_amp


def window_spectrum(df: DataFrame, spec: SeriesSpec, value: str, n: int = 168, step: int = 24,
                    method: str = "fft") -> DataFrame:
    """Per window the amplitude spectrum, the dominant non-zero
    frequency (cycles per row) and the energy sum |X_k|^2 over the bins."""
    w = window_arrays(df, spec, value, n, step)
    amp = amplitudes_basis(F.col("xs"), n) if method == "basis" else _fft_udf(n)(F.col("xs"))
    w = w.withColumn("amplitude", amp)
    nz = F.slice("amplitude", 2, n // 2 - 1)
    dom_k = F.array_position(nz, F.array_max(nz)) # first maximum, 1-based within bins 1..
    energy = F.aggregate("amplitude", F.lit(0.0), lambda acc, a: acc + a * a)
    return w.select(*spec.keys, "win", "anchor_pos", "amplitude",
                    (dom_k.cast("double") / n).alias("dominant_freq"), energy.alias("spectral_energy"))


def top_frequencies(spectra: DataFrame, keys, n: int, k: int = 5) -> DataFrame:
    """The k largest amplitudes of each window (ties: lower frequency),
    as (rank, freq, amplitude) rows."""
    ranked = spectra.select(*keys, "win", "anchor_pos", F.posexplode("amplitude").alias("bin", "amp"))
    w = Window.partitionBy(*keys, "win").orderBy(F.desc("amp"), "bin")
    return (ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(*keys, "win", "anchor_pos", F.col("rank").cast("int").alias("rank"),
                    (F.col("bin") / n).alias("freq"), F.col("amp").alias("amplitude")))


def spectral_features(df: DataFrame, spec: SeriesSpec, value: str, n: int = 168, step: int = 24,
                      top: int = 5, method: str = "fft") -> DataFrame:
    """The ``top`` strongest frequencies and the energy of the latest
    window ending before each row, carried forward to every row; rows
    before the first window take the first window's values."""
    keys = list(spec.keys)
    sp = window_spectrum(df, spec, value, n, step, method)
    order = F.transform(F.sort_array(F.transform(F.arrays_zip(
        F.col("amplitude").alias("a"), F.sequence(F.lit(0), F.lit(n // 2 - 1)).alias("k")),
        lambda e: F.struct((-e["a"]).alias("na"), e["k"].alias("k")))), lambda e: e["k"])
    feats = sp.select(*keys, "anchor_pos", *[(F.element_at(order, i + 1) / n).alias(f"{value}_dom_freq_{i + 1}")
                                             for i in range(top)],
                      F.col("spectral_energy").alias(f"{value}_spectral_energy"))
    names = [f"{value}_dom_freq_{i + 1}" for i in range(top)] + [f"{value}_spectral_energy"]
    # each row takes the last window at or before it (windows are few: a
    # per-series table of len/step rows, joined on the window index)
    d = _with_length(df, spec)
    first_anchor = n + 1
    win = F.when(F.col(POS) >= first_anchor, F.floor((F.col(POS) - first_anchor) / step)).otherwise(F.lit(0))
    last_win = F.floor((F.col("_len") - 1 - n) / step)
    d = d.withColumn("_win", F.least(win, last_win).cast("long"))
    fw = feats.withColumn("_win", F.floor((F.col("anchor_pos") - first_anchor) / step).cast("long")).drop("anchor_pos")
    out = d.join(fw, keys + ["_win"], "left")
    return out.select(*df.columns, *names)


def hurst_rs(df: DataFrame, spec: SeriesSpec, value: str, last_n: int = 168,
             min_size: int = 8) -> DataFrame:
    """Rescaled-range exponent over the last ``last_n`` rows: for
    chunk sizes s = 8, 16, ... <= last_n/2, the mean over whole chunks of
    (max - min of the cumulative de-meaned sum) / population std, then the
    least-squares slope of ln(R/S) on ln(s).  Reading: < 0.5
    mean-reverting, > 0.5 persistent."""
    keys = list(spec.keys)
    sizes = []
    s = min_size
    while s <= last_n // 2:
        sizes.append(s)
        s *= 2
    d = latest(df.select(*keys, *spec.order_cols, value), spec, last_n)
    tail = Window.partitionBy(*keys)                          # at most last_n rows
    r0 = F.row_number().over(tail.orderBy(*spec.order_cols)) - 1
    d = d.select(*keys, value, r0.alias("_r"), F.count(F.lit(1)).over(tail).alias("_m"))
    d = d.select("*",
                 F.explode(F.array(*[F.lit(x) for x in sizes])).alias("size"))
    d = d.withColumn("chunk", F.floor(F.col("_r") / F.col("size")))
    d = d.filter((F.col("chunk") + 1) * F.col("size") <= F.col("_m"))
    cw = Window.partitionBy(*keys, "size", "chunk")
    d = d.withColumn("_dev", F.col(value) - F.avg(value).over(cw))
    run = cw.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_y", F.sum("_dev").over(run))
    ch = d.groupBy(*keys, "size", "chunk").agg(
        (F.max("_y") - F.min("_y")).alias("_R"), F.stddev_pop(value).alias("_S"))
    ch = ch.filter(F.col("_S") > 0)
    per = ch.groupBy(*keys, "size").agg(F.avg(F.col("_R") / F.col("_S")).alias("rs"))
    h = per.groupBy(*keys).agg(F.regr_slope(F.log("rs"), F.log(F.col("size").cast("double"))).alias("hurst"),
                               F.count(F.lit(1)).alias("n_sizes"))
    reading = (F.when(F.col("hurst") < 0.5, "mean-reverting").when(F.col("hurst") > 0.5, "persistent")
               .otherwise("random walk"))
    return h.withColumn("reading", reading)

"""Position-based operators: chronological split (W22), expanding time
folds (W23), latest rows (W26) and the one-class label fallback (W21).

The first two need a row position and the series length.  Both come from
``with_positions`` (bucketed counts + offsets, no global sort).  The latest
rows need neither: the ranking keeps n rows per series and task before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirro.operators.windows import _with_length, future_label_col
from cirro.plans.layout import run_windows
from cirro.plans.series import POS, SeriesSpec


def chronological_split(df: DataFrame, spec: SeriesSpec, train: float = 0.6,
                        valid: float = 0.8, name: str = "split") -> DataFrame:
    """First ``train`` share by position -> 'train', up to ``valid`` ->
    'validation', rest 'test' (``floor`` of n * share, as ``int()``)."""
    d = _with_length(df, spec)
    n = F.col("_len")
    lab = (F.when(F.col(POS) <= F.floor(n * train), "train")
           .when(F.col(POS) <= F.floor(n * valid), "validation").otherwise("test"))
    return d.withColumn(name, lab).drop("_len", POS)


def time_folds(df: DataFrame, spec: SeriesSpec, k: int = 3) -> DataFrame:
    """Expanding-window folds: test size n // (k+1); fold i tests rows
    (n-(k-i)*t, n-(k-i-1)*t] and trains on everything before.  Output is
    long: one row per (row, fold) the row takes part in, with its role."""
    d = _with_length(df, spec)
    t = F.floor(F.col("_len") / (k + 1))
    folds = F.sequence(F.lit(0), F.lit(k - 1))
    x = d.withColumn("fold", F.explode(folds))
    end = F.col("_len") - (k - 1 - F.col("fold")) * t
    start = F.col("_len") - (k - F.col("fold")) * t
    x = x.filter(F.col(POS) <= end)
    return (x.withColumn("role", F.when(F.col(POS) <= start, "train").otherwise("test"))
            .withColumn("fold", F.col("fold").cast("int")).drop("_len", POS))


def latest(df: DataFrame, spec: SeriesSpec, n: int = 1) -> DataFrame:
    """Last ``n`` rows of every series."""
    newest = Window.partitionBy(*spec.keys).orderBy(*[F.desc(c) for c in spec.order_cols])
    return df.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= n).drop("_back")


def alternative_label(df: DataFrame, spec: SeriesSpec, c: str, horizon: int,
                      thr: float, thr_alt: float, name: str = "label") -> DataFrame:
    """W19 label with ``thr``; series where it has one class only are
    relabelled with ``thr_alt``.  ``label_rule`` records which one ran."""
    lab = run_windows(df, spec, lambda sw: [
        ("_y_main", future_label_col(sw, c, horizon, thr)),
        ("_y_alt", future_label_col(sw, c, horizon, thr_alt)),
    ], lookahead=horizon)
    keys = list(spec.keys)
    classes = lab.groupBy(*keys).agg(F.countDistinct("_y_main").alias("_k"))
    j = lab.join(classes, keys, "left")
    single = F.col("_k") < 2
    return (j.withColumn(name, F.when(single, F.col("_y_alt")).otherwise(F.col("_y_main")).cast("int"))
            .withColumn("label_rule", F.when(single, "alternative").otherwise("primary"))
            .drop("_y_main", "_y_alt", "_k"))

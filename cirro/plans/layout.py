"""Exact row positions and the blocked (halo) layout for series windows.

Why: a plain ``Window.partitionBy(series)`` sends a whole series to one
task.  If one series holds a third of a 100 TB table, that task never
finishes.  Row-based frames (pandas ``rolling(n)``, ``shift(h)``) only
look a bounded number of rows back or ahead, so a series can be cut into
blocks of ``block_rows`` consecutive rows, each block carrying a halo of
the ``lookback`` rows before it and the ``lookahead`` rows after it.
Windows then run per (series, block) and the halo rows are dropped.  The
result is identical to the unblocked computation.

Row positions are computed without a global sort:

1. rows are bucketed by wall-clock time (``bucket_seconds``), and the
   rows per (series, bucket) are counted -- a partial/final aggregate;
2. a running sum over that small count table gives each bucket's offset;
3. the offsets are joined back (AQE broadcasts the count table when its
   measured size is small, otherwise it is a shuffle join on
   (series, bucket)) and ``row_number`` inside (series, bucket) adds the
   local rank.  No task holds more than one bucket of one series.

Unbounded running quantities (running max, last event position) are
handled by ``with_block_carry``: a per-block summary, a running combine
over the (small) block table, and a join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirro.plans.series import BLK, CORE, POS, SeriesSpec, SeriesWindow

_BKT = "_bkt"
_OFF = "_off"


def _bucket(df: DataFrame, spec: SeriesSpec) -> Column:
    dtype = df.schema[spec.order].dataType
    c = F.col(spec.order)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
        if isinstance(dtype, T.DateType) or spec.bucket_seconds % 86_400 == 0:
            return F.floor(days / F.lit(max(1, spec.bucket_seconds // 86_400)))
        secs = (days * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
                + F.floor(F.second(c)))
        return F.floor(secs / F.lit(spec.bucket_seconds))
    return F.floor(c.cast("double") / F.lit(float(spec.bucket_seconds)))


def join_by_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` where all keys are equal, null to null; the keys of ``left`` stay."""
    r = right.select(*[F.col(k).alias(f"_rk_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_rk_{k}"))
    return left.join(r, cond, how).drop(*[f"_rk_{k}" for k in keys])


def with_positions(df: DataFrame, spec: SeriesSpec, length: str | None = None) -> DataFrame:
    """Add ``_pos``: 1-based row position inside the series (exact).

    ``length`` names a further column for the series' row count, taken from
    the same count table.
    """
    keys = list(spec.keys)
    b = df.withColumn(_BKT, _bucket(df, spec))
    counts = b.groupBy(*keys, _BKT).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(_BKT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col(_BKT).alias("_o_bkt"),
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(_OFF),
        *([F.sum("_n").over(Window.partitionBy(*keys)).alias(length)] if length else []),
    )
    cond = None
    for k in keys:
        e = b[k].eqNullSafe(offsets[f"_o_{k}"])
        cond = e if cond is None else cond & e
    cond = cond & b[_BKT].eqNullSafe(offsets["_o_bkt"])
    joined = b.join(offsets, cond, "inner")
    local = Window.partitionBy(*keys, _BKT).orderBy(*spec.order_cols)
    return joined.select(
        *[F.col(c) for c in df.columns],
        (F.col(_OFF) + F.row_number().over(local)).alias(POS),
        *([F.col(length)] if length else []),
    )


def blocked(df_pos: DataFrame, spec: SeriesSpec, lookback: int = 0,
            lookahead: int = 0) -> DataFrame:
    """Replicate halo rows so every block sees its neighbours' edge rows.

    Adds ``_blk`` (block id) and ``_core`` (True for the block's own rows).
    """
    B = spec.block_rows
    p0 = F.col(POS) - 1
    blk = F.floor(p0 / F.lit(B)).cast("long")
    r = p0 - blk * B
    targets = [F.struct(blk.alias("b"), F.lit(True).alias("c"))]
    # block b+j needs this row as halo when it lies in its last `lookback`
    # rows before (b+j)*B; block b-j when it lies in its first `lookahead`
    # rows after (b-j+1)*B.  A reach longer than a block spans several.
    for j in range(1, -(-lookback // B) + 1 if lookback > 0 else 1):
        targets.append(F.when(r >= j * B - lookback,
                              F.struct((blk + j).alias("b"), F.lit(False).alias("c"))))
    for j in range(1, -(-lookahead // B) + 1 if lookahead > 0 else 1):
        targets.append(F.when((r < lookahead - (j - 1) * B) & (blk >= j),
                              F.struct((blk - j).alias("b"), F.lit(False).alias("c"))))
    if len(targets) == 1:
        return df_pos.withColumn(BLK, blk).withColumn(CORE, F.lit(True))
    arr = F.filter(F.array(*targets), lambda s: s.isNotNull())
    return (df_pos.withColumn("_t", F.explode(arr))
            .withColumn(BLK, F.col("_t.b")).withColumn(CORE, F.col("_t.c"))
            .drop("_t"))


def run_windows(df: DataFrame, spec: SeriesSpec, build, lookback: int = 0,
                lookahead: int = 0, keep_pos: bool = False,
                positioned: bool = False) -> DataFrame:
    """Evaluate window expressions from ``build(sw)`` on the blocked layout.

    ``build`` returns a list of ``(name, Column)``; all of them go into one
    ``select`` so Catalyst plans a single Window node.
    """
    pos = df if positioned else with_positions(df, spec)
    blk = blocked(pos, spec, lookback, lookahead)
    sw = SeriesWindow(spec)
    exprs = build(sw)
    base = [c for c in pos.columns if c != POS]
    out = blk.select(*base, POS, CORE, *[e.alias(n) for n, e in exprs])
    out = out.filter(F.col(CORE)).drop(CORE)
    return out if keep_pos else out.drop(POS)


def with_block_carries(df_pos: DataFrame, spec: SeriesSpec, carries) -> DataFrame:
    """Attach, per row, combines of per-block summaries over all *earlier*
    blocks (or all *later* blocks).

    ``carries`` is a list of ``(agg, combine, name, after)`` with combine in
    'max'/'min'/'sum'.  All summaries come from one ``groupBy(series,
    block)`` and one window pass over that small table, and are attached
    with one join, so the plan does not grow with the number of carries.
    Used for unbounded running frames (running max, last event position,
    previous/next valid value) on the blocked layout.
    """
    keys = list(spec.keys)
    blk = F.floor((F.col(POS) - 1) / F.lit(spec.block_rows)).cast("long")
    per = df_pos.groupBy(*keys, blk.alias(BLK)).agg(
        *[agg.alias(f"_m{i}") for i, (agg, _, _, _) in enumerate(carries)])
    fns = {"max": F.max, "min": F.min, "sum": F.sum}
    base = Window.partitionBy(*keys).orderBy(BLK)
    cols = []
    for i, (_, combine, name, after) in enumerate(carries):
        w = (base.rowsBetween(1, Window.unboundedFollowing) if after
             else base.rowsBetween(Window.unboundedPreceding, -1))
        cols.append(fns[combine](f"_m{i}").over(w).alias(name))
    carry = per.select(*[F.col(k).alias(f"_c_{k}") for k in keys],
                       F.col(BLK).alias("_c_blk"), *cols)
    d = df_pos.withColumn("_cb", blk)
    cond = None
    for k in keys:
        e = d[k].eqNullSafe(carry[f"_c_{k}"])
        cond = e if cond is None else cond & e
    cond = cond & (d["_cb"] == carry["_c_blk"])
    return (d.join(carry, cond, "left")
            .drop(*[f"_c_{k}" for k in keys], "_c_blk", "_cb"))


def with_block_carry(df_pos: DataFrame, spec: SeriesSpec, agg: Column,
                     combine: str, name: str, after: bool = False) -> DataFrame:
    """One carry; see ``with_block_carries``."""
    return with_block_carries(df_pos, spec, [(agg, combine, name, after)])

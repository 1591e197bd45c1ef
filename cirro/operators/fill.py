"""Gap repair: hourly grid, limited interpolation, fill cascades.

* ``hourly_grid``  complete hourly index per series (the reference always
  receives one; ours is built with ``sequence`` per series-day, so no
  single row explodes into a whole series).
* ``interpolate``  pandas ``interpolate(method='linear'|'time',
  limit=L, limit_direction='both')``: a NULL is filled when it lies at
  most L rows after the previous valid value or before the next one; the
  value is the straight line between the two neighbours (by position or
  by time), extended flat at the series ends.  Neighbours are found with
  running ``last``/``first`` over the blocked layout plus block carries,
  so holes of any length are handled exactly.
* ``fill_with_stat`` median or mean per series as last-resort fill
  (median via ``exact_quantiles``).
* ``fill_cascade`` (M1) and ``feature_fill`` (M3) chain the above.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirro.operators.quantiles import exact_quantiles
from cirro.operators.windows import bfill_col, ffill_col
from cirro.plans.layout import join_by_keys, run_windows, with_block_carries, with_positions
from cirro.plans.series import POS, SeriesSpec
from cirro.session import cut_lineage


def hourly_grid(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Left join of the data onto every hour between each series' first
    and last timestamp."""
    keys = list(spec.keys)
    t = spec.order
    rng = df.groupBy(*keys).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    days = rng.select(*keys, "_t0", "_t1", F.explode(F.sequence(
        F.to_date("_t0"), F.to_date("_t1"), F.expr("INTERVAL 1 DAY"))).alias("_d"))
    hours = days.select(*keys, "_t0", "_t1", "_d", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("_h"))
    grid = hours.select(*keys, F.make_timestamp_ntz(F.year("_d"), F.month("_d"), F.dayofmonth("_d"),
                                                    F.col("_h"), F.lit(0), F.lit(0)).alias(t),
                        "_t0", "_t1")
    grid = grid.filter((F.col(t) >= F.col("_t0")) & (F.col(t) <= F.col("_t1"))).drop("_t0", "_t1")
    return grid.join(df, keys + [t], "left")


def _seconds(c):
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            F.col(c) if isinstance(c, str) else c) / 1e6


def interpolate(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], method: str = "linear",
                limit: int = 24, positioned: bool = False) -> DataFrame:
    cols = list(cols)
    pos = df if positioned else with_positions(df, spec)
    tnum = _seconds(spec.order) if method == "time" else F.col(POS).cast("double")
    carries = []
    for c in cols:
        ok = F.col(c).isNotNull()
        pt = F.struct(F.col(POS).alias("p"), tnum.alias("t"), F.col(c).alias("v"))
        carries.append((F.max(F.when(ok, pt)), "max", f"_cp_{c}", False))
        carries.append((F.min(F.when(ok, pt)), "min", f"_cn_{c}", True))
    pos = with_block_carries(pos, spec, carries)

    def build(sw):
        out = []
        from pyspark.sql import Window
        fwd = sw.w.rowsBetween(0, Window.unboundedFollowing)
        for c in cols:
            ok = F.col(c).isNotNull()
            pt = F.struct(F.col(POS).alias("p"), tnum.alias("t"), F.col(c).alias("v"))
            prev = F.coalesce(F.last(F.when(ok, pt), ignorenulls=True).over(sw.running()),
                              F.col(f"_cp_{c}"))
            nxt = F.coalesce(F.first(F.when(ok, pt), ignorenulls=True).over(fwd),
                             F.col(f"_cn_{c}"))
            out.append((f"_prev_{c}", prev))
            out.append((f"_next_{c}", nxt))
        return out
    w = run_windows(pos, spec, build, positioned=True, keep_pos=True)
    sel = []
    for f in w.columns:
        if f.startswith(("_prev_", "_next_", "_cp_", "_cn_")):
            continue
        if f in cols:
            p, n = F.col(f"_prev_{f}"), F.col(f"_next_{f}")
            dp = F.col(POS) - p["p"]
            dn = n["p"] - F.col(POS)
            within = (p.isNotNull() & (dp <= limit)) | (n.isNotNull() & (dn <= limit))
            t_here = tnum
            span = n["t"] - p["t"]
            line = F.when(span != 0, p["v"] + (n["v"] - p["v"]) * (t_here - p["t"]) / span).otherwise(p["v"])
            val = (F.when(p.isNotNull() & n.isNotNull(), line)
                   .when(p.isNotNull(), p["v"]).otherwise(n["v"]))
            sel.append(F.when(F.col(f).isNotNull(), F.col(f))
                       .when(within, val).alias(f))
        else:
            sel.append(F.col(f))
    out = w.select(*sel)
    return out if positioned else out.drop(POS)


def fill_with_stat(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], how: str = "median",
                   default: float | None = None, fit_mask: str | None = None) -> DataFrame:
    """Fill NULLs with the per-series median or mean of each column.

    The statistic is that of the rows where ``fit_mask`` is true (all rows
    when None).  Means are one aggregate; for medians the columns are
    stacked into one long (series, variable, value) table, so one quantile
    job and one join serve every column.
    """
    keys = list(spec.keys)
    cols = list(cols)
    fit = df.filter(F.col(fit_mask)) if fit_mask else df
    if how == "median":
        long = fit.select(*keys, F.inline(F.array(*[
            F.struct(F.lit(c).alias("_var"), F.col(c).cast("double").alias("_v")) for c in cols])))
        st = exact_quantiles(long, keys + ["_var"], "_v", [0.5], ["_st"])
        wide = st.groupBy(*keys).agg(*[F.max(F.when(F.col("_var") == c, F.col("_st"))).alias(f"_st_{c}")
                                       for c in cols])
    else:
        wide = fit.groupBy(*keys).agg(*[F.avg(F.col(c).cast("double")).alias(f"_st_{c}") for c in cols])
    out = join_by_keys(df, wide, keys, "left")
    sel = []
    for f in df.columns:
        if f in cols:
            fill = F.coalesce(F.col(f), F.col(f"_st_{f}"))
            if default is not None:
                fill = F.coalesce(fill, F.lit(default))
            sel.append(fill.alias(f))
        else:
            sel.append(F.col(f))
    return out.select(*sel)


def fill_cascade(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], limit: int = 24, k: int = 5) -> DataFrame:
    """M1: time interpolation (``limit``), then the nearest rows of the series by the columns both have, then its median."""
    cols = list(cols)
    out = interpolate(df, spec, cols, "time", limit)
    if len(cols) > 1:
        out = out.withColumn("_row", F.struct(*spec.keys, *spec.order_cols)).withColumn("_series", F.struct(*spec.keys))
        out = knn_impute(out, "_row", cols, k, "_series").drop("_row", "_series")
    return fill_with_stat(out, spec, cols, "median")


def feature_fill(df: DataFrame, spec: SeriesSpec, cols: Sequence[str],
                 ffill_limit: int = 168, bfill_limit: int = 168, interp_limit: int = 24) -> DataFrame:
    """M3: ffill(168) -> bfill(168) -> linear(24) -> series mean -> 0."""
    pos = with_positions(df, spec)

    def build(sw):
        return [(f"_f_{c}", ffill_col(sw, c, ffill_limit)) for c in cols]
    a = run_windows(pos, spec, build, lookback=ffill_limit, positioned=True, keep_pos=True)
    a = a.select(*[F.col(f"_f_{c}").alias(c) if c in cols else F.col(c)
                   for c in a.columns if not c.startswith("_f_")])

    def build_b(sw):
        return [(f"_f_{c}", bfill_col(sw, c, bfill_limit)) for c in cols]
    b = run_windows(a, spec, build_b, lookahead=bfill_limit, positioned=True, keep_pos=True)
    b = b.select(*[F.col(f"_f_{c}").alias(c) if c in cols else F.col(c)
                   for c in b.columns if not c.startswith("_f_")])
    c_ = interpolate(b, spec, cols, "linear", interp_limit, positioned=True).drop(POS)
    return fill_with_stat(c_, spec, cols, "mean", 0.0)


def knn_impute(df: DataFrame, key: str, cols: Sequence[str], k: int = 5, group: str | None = None) -> DataFrame:
    """M2: a missing value of ``cols`` becomes the mean of the ``k`` nearest rows that have it, weighted by
    the inverse distance (rows at distance 0: their plain mean).

    The distance of two rows is Euclidean over the columns both have, scaled
    up by all columns over those; ties go to the smaller ``key`` (unique).  With
    ``group`` only rows of the same group count.  Rows that share no column with
    a row that has the value stay as they are.  Columns may be missing in any
    combination: rows are searched by the pair of patterns, own and neighbour's,
    all pairs in one search, with the columns that aren't shared set to 0.
    """
    from cirro.operators.neighbours import nearest
    cols, every = list(cols), (1 << len(list(cols))) - 1
    bits = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0))
    rows = cut_lineage(df.withColumn("_bits", bits))
    patterns = sorted(r[0] for r in rows.select("_bits").distinct().collect())          # 2 ** len(cols) at most
    pairs = [(a, b) for a in patterns if a != every for b in patterns if a & b and b & ~a]
    if not pairs:
        return df
    own = F.struct(*([F.col(group).alias("g")] if group else []), F.col("_a"), F.col("_b"))

    def side(of: str, tag: str):
        few = df.sparkSession.createDataFrame(pairs, "_a int, _b int")
        j = rows.join(F.broadcast(few), F.col("_bits") == F.col(of))
        shared = F.col("_a").bitwiseAND(F.col("_b"))
        ident = F.struct(F.col(key).alias("key"), "_b") if tag == "p" else F.col(key)
        return j.select(ident.alias(f"{tag}id"), own.alias(f"{tag}g"), *[
            F.when(shared.bitwiseAND(1 << i) > 0, F.col(c).cast("double")).otherwise(0.0).alias(f"{tag}{i}") for i, c in enumerate(cols)], shared.alias("_shared"))

    points = side("_a", "p")
    near = nearest(points.drop("_shared"), side("_b", "s").drop("_shared"), len(cols), k)
    scale = points.select(F.col("pid").alias("_pp"), F.sqrt(F.lit(float(len(cols))) / F.bit_count("_shared")).alias("_scale"))
    near = near.join(scale, near["pid"] == scale["_pp"])
    missing = rows.select(F.col(key).alias("_mk"), F.col("_bits").alias("_have"))
    near = near.select(F.col("pid.key").alias("_pk"), F.col("pid._b").alias("_donor_bits"), "sid", (F.col("_d") * F.col("_scale")).alias("_d"))
    near = near.join(missing, near["_pk"] == missing["_mk"]).drop("_mk")
    donors = rows.select(F.col(key).alias("_dk"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    near = near.join(donors, near["sid"] == donors["_dk"])
    cells = near.select("_pk", "sid", "_d", F.inline(F.array(*[
        F.struct(F.lit(i).alias("_c"), F.when(F.col("_have").bitwiseAND(1 << i) == 0, F.col(f"_v{i}")).alias("_v")) for i in range(len(cols))])))
    w = Window.partitionBy("_pk", "_c").orderBy("_d", "sid")
    best = cells.filter(F.col("_v").isNotNull()).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    zero = F.col("_d") == 0
    est = best.groupBy("_pk", "_c").agg(
        F.avg(F.when(zero, F.col("_v"))).alias("_z"),
        (F.sum(F.when(~zero, F.col("_v") / F.col("_d"))) / F.sum(F.when(~zero, 1 / F.col("_d")))).alias("_w"))
    wide = est.groupBy(F.col("_pk").alias("_ek")).agg(*[F.max(F.when(F.col("_c") == i, F.coalesce("_z", "_w"))).alias(f"_e{i}") for i in range(len(cols))])
    out = rows.join(wide, rows[key] == wide["_ek"], "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"_e{cols.index(c)}")).alias(c) if c in cols else F.col(c) for c in df.columns])

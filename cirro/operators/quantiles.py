"""Exact per-group quantiles without gathering a group into one task.

Rows that are equal are counted first (a partial aggregate), so a value that
most rows share costs one row.  Ranks are running sums of these counts.

A group of more than ``max_rows`` rows is narrowed down before: it is cut at
the points of a sketch (``percentile_approx``, bounded memory) into buckets,
those that hold a wanted rank are found from the buckets' counts, and only
their rows go on, again and again until each holds ``max_rows`` at most.
Rows equal to a cut point are a bucket of their own, which needs no ranking.

Keys may be null: they are compared as one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirro.session import cut_lineage

_K = "_qk"


def _ranks(probs: Sequence[float]):
    """(0-based) ranks on both sides of each probability among ``_n`` rows."""
    n = F.col("_n")
    for p in probs:
        lo = F.floor((n - 1) * F.lit(float(p)))
        yield lo, F.least(lo + 1, n - 1), (n - 1) * F.lit(float(p)) - lo


def _wanted(probs: Sequence[float]):
    """All wanted ranks as an array."""
    return F.array(*[r for lo, hi, _ in _ranks(probs) for r in (lo, hi)])


def _narrowed(x: DataFrame, sizes: DataFrame, probs: Sequence[float], n_buckets: int, max_rows: int) -> DataFrame:
    """(_qk, _cell, _off, _x, _c): rows, or counted equal rows, of buckets that hold wanted ranks; ``_off`` ranks lie before the bucket."""
    points = [i / n_buckets for i in range(1, n_buckets)]
    rows = x.withColumn("_cell", F.lit(0).cast("long")).withColumn("_off", F.lit(0).cast("long"))
    ranks = sizes.select(F.col(_K).alias("_rk"), _wanted(probs).alias("_want"))
    out = None
    while True:
        cuts = rows.groupBy(_K, "_cell").agg(F.array_distinct(F.percentile_approx("_x", points, 10_000)).alias("_cuts"))
        cuts = cuts.select(F.col(_K).alias("_ck"), F.col("_cell").alias("_cc"), "_cuts")
        j = rows.join(cuts, (rows[_K] == cuts["_ck"]) & (rows["_cell"] == cuts["_cc"])).drop("_ck", "_cc")
        below = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
        j = j.withColumn("_b", 2 * below + F.array_contains("_cuts", F.col("_x")).cast("int")).drop("_cuts")
        counts = j.groupBy(_K, "_cell", "_off", "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        w = Window.partitionBy(_K, "_cell").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_start", F.col("_off") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
        counts = counts.join(ranks, counts[_K] == ranks["_rk"]).filter(
            F.exists("_want", lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_c"))))
        cell = (F.col("_cell") * (2 * n_buckets) + F.col("_b")).alias("_cell")
        held = cut_lineage(counts.select(_K, F.col("_cell").alias("_of"), "_b", cell, F.col("_start").alias("_off"), "_c", "_low", "_high"))
        equal = held.filter("_low = _high").select(_K, "_cell", "_off", F.col("_low").alias("_x"), "_c")
        out = equal if out is None else out.union(equal)
        mixed = held.filter("_low < _high")
        h = mixed.select(F.col(_K).alias("_hk"), F.col("_of").alias("_ho"), F.col("_b").alias("_hb"), F.col("_cell").alias("_hc"), F.col("_off").alias("_hoff"))
        rows = j.join(h, (j[_K] == h["_hk"]) & (j["_cell"] == h["_ho"]) & (j["_b"] == h["_hb"])).select(
            _K, F.col("_hc").alias("_cell"), F.col("_hoff").alias("_off"), "_x")
        most = mixed.agg(F.max("_c")).first()[0]
        if (most or 0) <= max_rows:
            return out.union(rows.select("*", F.lit(1).cast("long").alias("_c")))
        rows = cut_lineage(rows)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str] | None = None,
                    n_buckets: int = 64, max_rows: int = 1 << 20) -> DataFrame:
    """One row per group with a column per probability, equal to ``percentile`` /
    ``numpy.quantile`` (linear interpolation); NULL values don't count."""
    keys, probs = list(keys), list(probs)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    x = df.select(F.struct(*keys).alias(_K), F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    sizes = x.groupBy(_K).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= max_rows:
        held = x.select(_K, F.lit(0).cast("long").alias("_cell"), F.lit(0).cast("long").alias("_off"), "_x", F.lit(1).cast("long").alias("_c"))
    else:
        held = _narrowed(x, sizes, probs, n_buckets, max_rows)
    counted = held.groupBy(_K, "_cell", "_off", "_x").agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy(_K, "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_end", F.col("_off") + F.sum("_c").over(w))
    n = sizes.select(F.col(_K).alias("_nk"), "_n")
    ranked = ranked.join(n, ranked[_K] == n["_nk"])
    start = F.col("_end") - F.col("_c")
    picks = [F.max(F.when((r >= start) & (r < F.col("_end")), F.col("_x"))).alias(f"_{side}{i}")
             for i, (lo, hi, _) in enumerate(_ranks(probs)) for side, r in (("lo", lo), ("hi", hi))]
    got = ranked.groupBy(_K, "_n").agg(*picks)
    return got.select(*[F.col(f"{_K}.{k}").alias(k) for k in keys], *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(nm) for i, ((_, _, frac), nm) in enumerate(zip(_ranks(probs), names))])

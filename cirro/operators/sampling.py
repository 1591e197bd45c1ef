"""Class rebalancing.

Row choice never depends on partitioning: every row gets a seeded 64-bit
hash of its key, and "the first m rows of a class" means the m smallest
hashes -- found with counts per hash bucket (no window over a
whole class, so a class holding most of the data is still split).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirro.operators.neighbours import forest_neighbours
from cirro.session import cut_lineage


def _u(cols: Sequence[str], seed: int, salt: str = ""):
    """Uniform [0, 1) from a seeded hash of the key columns."""
    h = F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(c) for c in cols])
    return (F.pmod(h, F.lit(2 ** 31)).cast("double") / float(2 ** 31))


def _take_smallest(df: DataFrame, key_cols: Sequence[str], m: int, seed: int, group_cols=()) -> DataFrame:
    """Exactly ``m`` rows with the smallest seeded hash (ties broken by key)."""
    if m <= 0:
        return df.limit(0)
    d = df.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols])).withColumn("_b", F.shiftright("_h", 48))
    sizes = sorted((r["_b"], r["count"]) for r in d.groupBy("_b").count().collect())   # 2^16 rows at most
    below, cut = 0, None
    for bucket, size in sizes:
        if below + size > m:
            cut = bucket
            break
        below += size
    if cut is None:
        return d.drop("_h", "_b")
    w = Window.partitionBy("_b").orderBy("_h", *key_cols)
    last = d.filter(F.col("_b") == cut).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= m - below)
    return d.filter(F.col("_b") < cut).unionByName(last.drop("_n")).drop("_h", "_b")


def balanced_subset(val: DataFrame, target_rate: float, key_cols: Sequence[str], label: str = "label",
                    tol: float = 0.05, seed: int = 42) -> DataFrame:
    """T4: the largest subset of ``val`` whose positive share equals the
    training share ``target_rate`` (unless already within ``tol``); rows
    are chosen by seeded hash and keep their time order (Q6, Q14)."""
    c = {r[label]: r["count"] for r in val.groupBy(label).count().collect()}   # two rows
    pos, neg = c.get(1, 0), c.get(0, 0)
    n = pos + neg
    if n == 0 or pos == 0 or neg == 0 or not 0 < target_rate < 1:
        return val
    if abs(pos / n - target_rate) <= tol:
        return val
    if pos / n > target_rate:
        keep_pos, keep_neg = int(neg * target_rate / (1 - target_rate)), neg
    else:
        keep_pos, keep_neg = pos, int(pos * (1 - target_rate) / target_rate)
    p = _take_smallest(val.filter(F.col(label) == 1), key_cols, keep_pos, seed)
    q = _take_smallest(val.filter(F.col(label) == 0), key_cols, keep_neg, seed)
    return p.unionByName(q)


def oversample_minority(train: DataFrame, key: str, features: Sequence[str], label: str = "label",
                        k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows x_i + lam * (x_j - x_i) until both
    classes are equal, j one of the k nearest minority neighbours of i
    over all ``features`` (``forest_neighbours``).

    Each minority row makes floor(need/m) or one more synthetic rows (those
    of the smallest seeded hashes); neighbour and lambda come from seeded
    hashes, so the result does not depend on partitioning.  Returns only the
    synthetic rows (``synthetic_id``, features, label)."""
    none = train.limit(0).select(F.lit(None).cast("string").alias("synthetic_id"), *features, label)
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}   # two rows
    if len(counts) < 2:
        return none
    minority = min(counts, key=lambda c: (counts[c], c))
    m, need = counts[minority], max(counts.values()) - counts[minority]
    if need <= 0 or m < 2:
        return none
    mino = cut_lineage(train.filter(F.col(label) == minority).select(key, *features))
    nn = cut_lineage(forest_neighbours(mino, key, features, k, seed=seed))
    base, extra = divmod(need, m)
    more = _take_smallest(mino.select(key), [key], extra, seed).select(F.col(key).alias("_mk"))
    gen = mino.join(more, mino[key] == more["_mk"], "left").withColumn("_g", F.lit(base) + F.col("_mk").isNotNull().cast("int")).drop("_mk")
    gen = gen.filter(F.col("_g") > 0).withColumn("_s", F.explode(F.sequence(F.lit(1), F.col("_g"))))
    gen = gen.join(nn.groupBy(key).agg(F.count(F.lit(1)).alias("_nk")), key)
    pick = (F.floor(_u([key, "_s"], seed, "nbr") * F.col("_nk")) + 1).cast("int")
    gen = gen.withColumn("rank", pick).withColumn("_lam", _u([key, "_s"], seed, "lam"))
    nbr = mino.select(F.col(key).alias("neighbour"), *[F.col(c).alias(f"_n_{c}") for c in features])
    j = gen.join(nn.select(key, "neighbour", "rank"), [key, "rank"]).join(nbr, "neighbour")
    return j.select(F.concat_ws("-", F.col(key).cast("string"), F.col("_s").cast("string")).alias("synthetic_id"),
                    *[(F.col(c) + F.col("_lam") * (F.col(f"_n_{c}") - F.col(c))).alias(c) for c in features],
                    F.lit(minority).cast("int").alias(label))


def append_synthetic(train: DataFrame, synthetic: DataFrame, label: str = "label") -> DataFrame:
    """Original rows plus the synthetic ones (``synthetic`` flag)."""
    cols = [c for c in synthetic.columns if c != "synthetic_id"]
    return (train.select(*cols).withColumn("synthetic", F.lit(False))
            .unionByName(synthetic.select(*cols).withColumn("synthetic", F.lit(True))))

"""Feature relevance and selection.

The reference scores features with scikit-learn's k-NN mutual-information
estimator; here the estimate is the plug-in mutual information of
equal-width bins (a binned estimator, not the k-NN one).  Features are
stacked into one long table so every feature is scored by the same
grouped aggregates, whatever the feature count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mutual_information(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "label",
                       bins: int = 10) -> DataFrame:
    """Sum over (bin, class) of p * ln(p / (p_bin * p_class)) per
    (group, feature), bins of equal width between the feature's min and
    max in the group (one bin when constant); NULL values are skipped."""
    keys = list(keys)
    long = df.filter(F.col(label).isNotNull()).select(*keys, F.col(label).alias("_y"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_v")) for c in features])))
    long = long.filter(F.col("_v").isNotNull())
    rng = long.groupBy(*keys, "feature").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    j = long.join(rng, keys + ["feature"])
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * bins), F.lit(bins - 1))).otherwise(0)
    cells = j.groupBy(*keys, "feature", b.alias("_b"), "_y").agg(F.count(F.lit(1)).alias("_c"))
    g = Window.partitionBy(*keys, "feature")
    n = F.sum("_c").over(g)
    nb = F.sum("_c").over(Window.partitionBy(*keys, "feature", "_b"))
    ny = F.sum("_c").over(Window.partitionBy(*keys, "feature", "_y"))
    t = cells.select(*keys, "feature", (F.col("_c") / n * F.log(F.col("_c") * n / (nb * ny))).alias("_t"))
    return t.groupBy(*keys, "feature").agg(F.sum("_t").alias("mi"))


def top_features(mi: DataFrame, keys: Sequence[str], n_features: int | None = None) -> DataFrame:
    """Keep the n best features by MI (name breaks ties), n =
    min(150, max(50, floor(0.3 * F))) as in the reference."""
    keys = list(keys)
    if n_features is None:
        cnt = mi.groupBy(*keys).agg(F.count(F.lit(1)).alias("_F"))
        mi = mi.join(cnt, keys)
        n = F.least(F.lit(150), F.greatest(F.lit(50), F.floor(F.col("_F") * 0.3)))
    else:
        n = F.lit(n_features)
    w = Window.partitionBy(*keys).orderBy(F.desc("mi"), "feature")
    return (mi.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select(*keys, "feature", "mi", F.col("rank").cast("int").alias("rank")))

"""Stage tables in the cluster's shared folder.

``stage(df)`` writes a DataFrame as Parquet below ``spark.checkpoint.dir``
and reads it back: lineage is cut, every executor can reread it after a
loss, and later reads prune columns.  ``drop`` removes a table that no
unfinished DataFrame reads any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cirro.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return it read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cirro-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

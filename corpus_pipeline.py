"""From raw documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and reread as the next
one's docs.  All but the last return the columns of documents.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: one document of each class of near duplicates stays.
3. decontamination: documents that hold a benchmark passage go.
4. secrets: secrets in the texts are replaced by a mark.
5. packing: what is left is packed into sequences of at most 2048 ids.

Null and empty texts go with the first stage if the classifier rejects
them, and are kept by the others; rows without doc_id are kept by all
that judge by doc_id; an empty table gives no rows; further columns stay up
to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cirro.llm import decontamination, minhash_dedup, packing, quality, secret_scan
from cirro.llm.queries import table, vocabulary_files
from cirro.llm.storage import stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_files())


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_class),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Trained models, near-duplicate classes and tokenisation can't be written in SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}

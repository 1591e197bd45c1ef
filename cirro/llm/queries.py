"""The registered queries of this package: name -> (builder, DuckDB SQL or None).

Each takes ``(spark, sf_dir)`` and applies its operator to the whole
intended table with production parameters; the columns of the query's
contract come first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cirro.llm.collocations import ORACLE_SQL as PHRASES_SQL
from cirro.llm.line_dedup import ORACLE_SQL as LINES_SQL

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_files() -> tuple[str, str, str]:
    import public_tokenizers as p
    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


@_query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cirro.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), vocabulary_files())


@_query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cirro.llm.secret_scan import digest, scan
    return digest(scan(table(spark, sf_dir, "documents")))


@_query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cirro.llm.suffix_dedup import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False, words=48).drop("removed")


@_query("op3_minhash_dedup")
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cirro.llm.minhash_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@_query("op5_embedding_dedup")
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cirro.llm.embedding_dedup import vector_links
    return vector_links(table(spark, sf_dir, "embeddings"))


@_query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cirro.llm.decontamination import find_passages
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cirro.llm.quality import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cirro.llm.toxicity import toxicity_scores
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    from cirro.llm.token_counts import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), p.path("piece_bpe_32k.model"))


@_query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cirro.llm.license_scan import scan_licenses
    return scan_licenses(table(spark, sf_dir, "documents"))


@_query("op13_line_dedup", LINES_SQL)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cirro.llm.line_dedup import digest, drop_common_lines
    return digest(drop_common_lines(table(spark, sf_dir, "documents")))


@_query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    from cirro.llm.token_alignment import align_tokenizers
    return align_tokenizers(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))


@_query("op11_collocations", PHRASES_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cirro.llm.collocations import collocations
    return collocations(table(spark, sf_dir, "documents"))

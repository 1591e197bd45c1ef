"""Lines that many documents share, dropped everywhere.

Each text is split at line feeds and every line normalised to a *key*: ASCII
white space off both ends, A-Z in lower case.  The keys of a document, each
once, are exploded and counted by two independent 64-bit hashes, which gives
the number of documents that hold a key.  Lines whose key reaches the
threshold are found again by position, the positions are gathered by
document, and what is left of the text is put together in order.

Only DataFrame functions run, and a hot line is never gathered: counting is
partial before its shuffle.  Common keys and positions are staged, so Spark
knows their size before it joins: it broadcasts them only where that allows
it, and else may split the hot partitions of lines and of texts.  A document's positions are bounded by its own
lines: rows that are equal in id and text share one set of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirro.llm.storage import stage

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(text: Column) -> Column:
    """The normalised lines of a text, in order."""
    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))


def two_hashes(names: tuple[str, str], *parts: Column) -> list[Column]:
    """128 bits: two hashes with seeds of their own."""
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in enumerate(names, 1)]


KEY, ROW = ("k1", "k2"), ("t1", "t2")


def common_keys(texts: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """k1, k2, n_docs of the keys of ``min_chars`` code points or more that ``min_docs`` rows or more hold."""
    keys = texts.select(F.explode(F.array_distinct(line_keys(F.col("text")))).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(*two_hashes(KEY, F.col("key"))).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept (the text that is left).

    ``docs`` needs doc_id and text.  A null or empty text is one empty line;
    keys under ``min_chars`` code points (1 or more) never go.  Every row counts as a
    document: rows that repeat a doc_id, or have none, are counted and
    returned one by one, copies of a text too; a line that a document repeats
    counts once for it and goes at all its places.  Exactly ``min_docs``
    documents are enough.  Very long texts are cut into lines whole; other
    columns are ignored; an empty table gives no rows.
    """
    if min_docs < 1 or min_chars < 1:
        raise ValueError("min_docs and min_chars start at 1")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    row = two_hashes(ROW, F.col("doc_id"), F.col("text"))
    lines = texts.select(*row, F.posexplode(line_keys(F.col("text"))).alias("at", "key")).where(F.char_length("key") >= min_chars)
    common = stage(common_keys(texts, min_docs, min_chars), "common-lines")
    found = lines.select(*ROW, "at", *two_hashes(KEY, F.col("key"))).join(common, list(KEY))
    gone = stage(found.groupBy(*ROW).agg(F.collect_set("at").alias("gone")), "gone-lines")
    whole = texts.select("doc_id", *row, F.split("text", "\n", -1).alias("lines")).join(gone, list(ROW), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.col("lines")[i])), "\n")
    return whole.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"), kept.alias("kept"))


def digest(dropped: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of ``drop_common_lines``."""
    return dropped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same over the view ``documents``, for DuckDB.
ORACLE_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT rid, doc_id, len(lines) AS n, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM texts
), keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10
)
SELECT any_value(doc_id) AS doc_id, any_value(n)::BIGINT AS n_lines,
       count(common.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY rid
"""

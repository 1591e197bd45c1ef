"""Line dedup against a version in plain Python, and on odd rows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cirro.llm import line_dedup

SCHEMA = "doc_id long, text string, key string, at int, lines long, t1 long"
BLANKS = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain(rows, min_docs, min_chars):
    held = Counter()
    for _, text in rows:
        held.update({key_of(x) for x in (text or "").split("\n")})
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(key_of(x)) < min_chars or held[key_of(x)] < min_docs]
        out.append((doc_id, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    lines = ["Home", "  home\t", "HOME", "ÀB", "àb", "x", "", "  ", "\r", "漢字 line", "a  b", "a b", "tail\r", "\x0bmid\x0c", " nbsp", "İ", "𝒜"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n", "Home", "no copy of this", "Home\n" * 2000]
    found = [(i, t) for i, t in enumerate(texts)]
    found += [(None, "of nobody\nHome")] * 12 + [(None, None), (5, "second five\nx"), (5, "second five\nx"), (7, "\n".join(f"line {i}" for i in range(20000)) + "\nHOME")]
    return found


@pytest.mark.parametrize("min_docs, min_chars", [(10, 1), (2, 3), (1, 1), (1000, 1)])
def test_brute_force(spark, rows, min_docs, min_chars):
    docs = spark.createDataFrame([(i, t, "k", 1, 2, 3) for i, t in rows], SCHEMA)
    got = line_dedup.digest(line_dedup.drop_common_lines(docs, min_docs, min_chars)).collect()
    assert Counter(map(tuple, got)) == plain(rows, min_docs, min_chars)


def test_threshold_is_reached_exactly(spark):
    for n, gone in ((9, 0), (10, 1)):
        docs = spark.createDataFrame([(i, f"The Line \nown {i}") for i in range(n)], "doc_id long, text string")
        got = line_dedup.drop_common_lines(docs)
        assert {r["n_dropped"] for r in got.collect()} == {gone}
        assert {r["kept"] for r in got.where("doc_id = 3").collect()} == {"own 3" if gone else "The Line \nown 3"}


def test_repeats_in_one_document_count_once(spark):
    docs = spark.createDataFrame([(1, "again\n" * 30)], "doc_id long, text string")
    assert line_dedup.drop_common_lines(docs).first()["n_dropped"] == 0


def test_empty_table_and_bad_parameters(spark):
    docs = spark.createDataFrame([], SCHEMA)
    got = line_dedup.digest(line_dedup.drop_common_lines(docs))
    assert got.count() == 0 and got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    with pytest.raises(ValueError):
        line_dedup.drop_common_lines(docs, 0)


def test_plans_run_without_python_and_count_partially(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text"))
    counts = line_dedup.common_keys(docs, 10, 1)
    for df in (counts, line_dedup.digest(line_dedup.drop_common_lines(docs))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    assert "partial_count" in counts._jdf.queryExecution().executedPlan().toString()

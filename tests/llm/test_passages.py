"""Passages that documents share, by words, against plain Python; and op4 on copies of one row."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cirro.llm import passages, suffix_dedup


def plain(rows, least):
    held = {}
    for i, text in rows:
        w = (text or "").split()
        for j in range(len(w) - least + 1):
            held.setdefault(tuple(w[j:j + least]), set()).add((i, text))
    return {(i, text): sum(len(held[tuple((text or "").split()[j:j + least])]) > 1 for j in range(len((text or "").split()) - least + 1)) for i, text in rows}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)

    def words(n):
        return ["".join(rng.choice("aeioulnrstbcdfg") for _ in range(rng.randint(1, 7))) for _ in range(n)]
    passage = words(70)
    out = []
    for i in range(60):
        w = words(rng.randint(0, 150))
        if i % 4 == 0:
            a, b = rng.randint(0, 30), rng.randint(35, 70)
            k = rng.randint(0, len(w))
            w[k:k] = passage[a:b]
        out.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    base = words(80)
    out += [(100 + i, " ".join(base[:40] + (["changed"] if i % 2 else []) + base[40:])) for i in range(6)]
    out += [(None, " ".join(passage)), (None, None), (7, ""), (8, "one two"), (200, " ".join(["again"] * 90)), (201, " ".join(base + base))]
    return out


@pytest.mark.parametrize("least, gap", [(48, 36), (20, 10), (12, 7)])
def test_brute_force(spark, rows, least, gap):
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(
        F.coalesce("doc_id", F.lit(suffix_dedup.NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    ids = {(r["doc"], r["text"]): r["who"] for r in docs.select("doc", "text", F.xxhash64("doc", "text_hash").alias("who")).collect()}
    got = {r["who"]: r["n_shared"] for r in passages.shared_strings(docs, least, gap).collect()}
    want = {ids[suffix_dedup.NO_ID if i is None else i, t or ""]: n for (i, t), n in plain(rows, least).items() if n}
    assert got == want and len(want) > 5


def test_query_column(spark, rows):
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_shared int")
    got = suffix_dedup.remove_repeats(docs, words=20).collect()
    want = plain(rows, 20)
    assert Counter((r["doc_id"], r["n_shared"]) for r in got) == Counter((i, want[i, t]) for i, t in rows)
    assert suffix_dedup.remove_repeats(docs.limit(0), words=20).count() == 0


def test_copies_of_one_row_cost_no_squares(spark):
    """300 rows without id and with one text: spans are gathered once."""
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    docs = spark.createDataFrame([(None, text)] * 300 + [(1, "own " * 30 + text[:700])], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs, with_kept=False).collect()
    assert len(got) == 301
    for r in got:
        if r["doc_id"] is None:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (3000, 3000, 1) and len(r["removed"]) == 1
        else:
            assert r["n_removed"] == 700 and r["n_spans"] == 1


def test_long_text_in_parts(monkeypatch):
    """Parts of a long text have the same phrases' strings as the whole."""
    import numpy as np
    from cirro.llm.textops import CLASS
    monkeypatch.setattr(passages, "CHUNK_BYTES", 60)
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(900)) + " " + "x" * 500 + " end"
    data = np.frombuffer(text.encode(), np.uint8)
    whole = passages.WordHashes(data, np.array([0, len(data)]))
    want = [int(whole.of(np.array([i]), np.array([i + 10]))[0]) for i in range(whole.count - 9)]
    got = {}
    for before, part, at in passages.word_slices(data, np.array([0, len(data)]), 10):
        w = passages.WordHashes(part, at)
        for i in range(w.count - 9):
            assert before + i not in got
            got[before + i] = int(w.of(np.array([i]), np.array([i + 10]))[0])
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want) > 800
    assert (CLASS[data] > 0).any()

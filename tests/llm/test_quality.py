"""Word vectors and pooled features against plain loops, in one slice and many."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirro.llm import quality
from cirro.llm.quality import DIM, FEATURES, NONZERO, SHAPES


def _prose(rng, n):
    return " ".join(rng.choice(["Ab", "cd", "efg", "h", "IJ", "klmno", "p-q", "éa", "12", "!!"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "one two", "one one one one", _prose(rng, 400), _prose(rng, 3)] + [_prose(rng, rng.randint(1, 40)) for _ in range(40)]
    out = list(enumerate(texts))
    return out + [(None, texts[6]), (6, texts[6]), (6, "other words"), (None, None)]


def _words(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    key, shape, _ = quality.word_keys(data, np.array([0, len(data)]))
    return [int(k) for k in key], [int(s) for s in shape]


def _row_words(rows, share):
    """Each row's row keys and shapes: words that occur twice and reach the share have their own."""
    every = [_words(text) for _, text in rows]
    counts = Counter(k for words, _ in every for k in words)
    own = {k for k, n in counts.items() if n >= max(2, share * sum(counts.values()))}
    place = {k: quality.FIRST + i for i, k in enumerate(sorted(own))}
    return [([place.get(k, k % quality.BUCKETS + SHAPES) for k in words], shapes) for words, shapes in every], own


def _plain(rows, share):
    every, own = _row_words(rows, share)
    index = quality.index_vectors(np.array(sorted(own), np.uint64))
    assert (np.abs(index.astype(int)).sum(axis=1) % 2 == 0).all() and (index != 0).sum(axis=1).max() == NONZERO
    sums = defaultdict(lambda: np.zeros(DIM))
    for pair in every:
        for seq in pair:
            for i, x in enumerate(seq):
                for j in range(max(0, i - 2), min(len(seq), i + 3)):
                    if j != i:
                        sums[x] += index[seq[j]]
    unit = {k: v / np.linalg.norm(v) for k, v in sums.items() if v.any()}
    common = np.mean(list(unit.values()), axis=0)
    vectors = defaultdict(lambda: np.zeros(DIM))
    for k, v in unit.items():
        vectors[k] = (v - common) / np.linalg.norm(v - common)
    out = []
    for (doc_id, _), (words, shapes) in zip(rows, every):
        x = np.zeros(FEATURES)
        if words:
            w, n = np.array([vectors[k] for k in words]), len(words)
            x[:DIM], x[DIM:2 * DIM] = w.mean(axis=0), (w * w).mean(axis=0)
            x[2 * DIM:3 * DIM] = np.mean([vectors[s] for s in shapes], axis=0)
            for gap in (1, 2, 3):
                x[3 * DIM + gap - 1] = sum(w[i] @ w[i + gap] for i in range(n - gap)) / n
            x[3 * DIM + 3:] = np.log1p(n), np.sqrt(1 / n)
        out.append((doc_id, x))
    return own, dict(sums), out


@pytest.mark.parametrize("share, slice_", [(quality.SHARE, quality.SLICE), (0.08, 5)])
def test_brute_force(spark, rows, monkeypatch, share, slice_):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    own, sums, plain = _plain(rows, share)
    frequent = quality.frequent_words(docs, share)
    assert frequent.tolist() == sorted(own) and 0 < len(own)
    table = {r["word"]: np.array(r[1:], float) for r in quality.context_sums(docs, frequent).collect()}
    assert all((table.get(k, 0) == v).all() for k, v in sums.items())
    monkeypatch.setattr(quality, "SLICE", slice_)             # slices of a text add up to the same
    index = quality.index_vectors(frequent)
    got = np.zeros(index.shape, np.int32)
    for _, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        word, shape, row = quality.word_keys(data, np.array([0, len(data)]))
        for seq in (quality.table_rows(word, frequent), shape):
            quality.add_neighbours(got, index, seq, row)
    assert all((got[k] == v).all() for k, v in sums.items())
    found = quality.featured(docs, quality.word_table(docs, share), ["doc_id"]).collect()
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, np.frombuffer(bytes(r["features"]), np.float32)) for r in found), key=lambda r: (*r[:2], r[2].round(1).tolist()))
    want = sorted(((i is None, i or 0, x) for i, x in plain), key=lambda r: (*r[:2], r[2].astype(np.float32).round(1).tolist()))
    assert [r[:2] for r in found] == [r[:2] for r in want]
    for a, b in zip(found, want):
        assert np.abs(a[2] - b[2]).max() < 0.02              # vectors are rounded to 1 in 127


def test_table_grows_with_the_vocabulary(spark):
    for n in (500, 5000):
        texts = spark.range(n).select(F.concat_ws(" ", *[F.concat(F.lit("w"), F.col("id") * 10 + i) for i in range(10)]).alias("text"))
        assert len(quality.frequent_words(texts.union(texts))) == 10 * n
        assert len(quality.frequent_words(texts)) == 0


def test_keep_good_takes_out_rejected_rows_only(spark, rows):
    from pyspark.sql.types import IntegerType
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("_bad", F.lit("x"))
    labels = docs.where("doc_id >= 8").select("doc_id", (F.col("doc_id") % 2).cast(IntegerType()).alias("quality"))
    scores = [r["score"] for r in quality.quality_scores(docs, labels, cut=0.5).collect()]
    kept = quality.keep_good(docs, labels, cut=0.5)
    assert kept.columns == docs.columns and kept.count() == sum(s >= 0.5 for s in scores)
    assert 0 < kept.count() < docs.count()

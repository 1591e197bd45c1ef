"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

At most ``max_rows`` labelled rows (smallest hashes of doc_id) are split by
hash in three: one part finds the lexicon (words and word beginnings that
stand out in toxic documents), one grows the trees, one fits the isotonic
curve; so the trees never see lexicon counts on the documents the lexicon
came from.  A fixed list of insults is counted beside the lexicon.

Features of a document: counts and densities of the fixed list, of the
lexicon's words and of its word beginnings, the sum of the lexicon's
log-odds, hits within five words of a second-person word, most hits in
fifty neighbouring words, and the rates of capitals, punctuation,
exclamation marks, obfuscated words (symbols or digits between letters)
and stretched letters.  They come from one pass over all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.quality import fold, training_rows
from cirro.llm.storage import stage
from cirro.llm.textops import CLASS, Rolling, text_chunks, words

# Insults and second-person words.
INSULTS = ("idiot stupid moron loser trash scum pathetic worthless disgusting clown dumb fool ugly filth garbage "
           "imbecile pig vermin hate idiota estupido imbécil basura escoria connard crétin abruti ordure salaud "
           "dummkopf abschaum arschloch widerlich").split()
YOU = ("you your yours yourself u ur tu te toi ton ta tes vous votre vos usted ustedes tú ti vosotros "
       "du dich dir dein deine ihr euch sie").split()
BEGINNINGS = (4, 5, 6)
NAMES = ["log_words", "insults", "insult_density", "lexicon", "lexicon_density", "beginnings", "beginning_density",
         "odds", "odds_density", "near_you", "near_you_share", "most_in_50", "capitals", "punctuation", "exclamation",
         "obfuscated", "stretched"]

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_MASK = np.zeros(256, dtype=bool)
_MASK[[ord(c) for c in "@$!*#013457"]] = True


def _hash_words(items: list[str]) -> np.ndarray:
    out = [Rolling(np.frombuffer(w.encode(), np.uint8)).of(np.array([0]), np.array([len(w.encode())]))[0] for w in items]
    return np.sort(np.array(out, dtype=np.uint64))


def _word_keys(data: np.ndarray, offsets: np.ndarray):
    """(start, end, row, hash of the word, list of hashes of its beginnings; shorter words have their own hash there)."""
    start, end, row = words(data, offsets)
    roll = Rolling(data)
    return start, end, row, roll.of(start, end), [roll.of(start, np.minimum(start + n, end)) ^ np.uint64(n) for n in BEGINNINGS]


def _member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Position of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def lexicon(sample: DataFrame, words_kept: int, beginnings_kept: int, least: int) -> dict:
    """Words and beginnings that stand out in toxic documents.  ``sample``: text, label (bounded)."""
    def run(batches):
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, _, data, offsets in text_chunks(batch.column(0)):
                _, _, row, whole, starts = _word_keys(_FOLD[data], offsets)
                for kind, keys in ((0, [whole]), (1, starts)):
                    key, docs = np.concatenate(keys), np.concatenate([row] * len(keys))
                    order = np.lexsort((key, docs))
                    key, docs = key[order], docs[order]
                    once = np.ones(len(key), dtype=bool)
                    once[1:] = (key[1:] != key[:-1]) | (docs[1:] != docs[:-1])
                    u, at = np.unique(key[once], return_inverse=True)
                    toxic = np.bincount(at, weights=label[a + docs[once]], minlength=len(u)).astype(np.int64)
                    total = np.bincount(at, minlength=len(u))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u.view(np.int64)),
                                                      pa.array(toxic), pa.array(total - toxic)], names=["kind", "key", "toxic", "clean"])

    counts = sample.select("text", F.col("label").cast("long").alias("label")).mapInArrow(run, "kind int, key long, toxic long, clean long")
    counts = counts.groupBy("kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    size = sample.groupBy("label").count().collect()                                    # two rows
    n = {int(r["label"]): r["count"] for r in size}
    n1, n0 = n.get(1, 0) + 1.0, n.get(0, 0) + 1.0
    odds = F.log((F.col("toxic") + 0.5) / n1) - F.log((F.col("clean") + 0.5) / n0)
    ranked = counts.where(F.col("toxic") >= least).withColumn("odds", odds).where("odds > 1.5")
    out = {}
    for kind, kept in ((0, words_kept), (1, beginnings_kept)):
        top = ranked.where(F.col("kind") == kind).orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "key").limit(kept).collect()
        key = np.array([r["key"] for r in top], dtype=np.int64).view(np.uint64)
        order = np.argsort(key)
        out[kind] = (key[order], np.array([r["odds"] for r in top])[order])
    return out


def dense(lex: dict, fixed: np.ndarray, you: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, features) of one chunk."""
    rows = len(offsets) - 1
    low = _FOLD[data]
    start, _, row, whole, starts = _word_keys(low, offsets)
    n = np.bincount(row, minlength=rows).astype(float)
    each = np.maximum(n, 1)

    def per_row(x):
        return np.bincount(row, weights=x, minlength=rows)

    def per_row_bytes(flag):
        c = np.concatenate(([0], np.cumsum(flag)))
        return (c[offsets[1:]] - c[offsets[:-1]]).astype(float)

    insult = _member(whole, fixed) >= 0
    at = _member(whole, lex[0][0])
    known = at >= 0
    begin = np.full(len(whole), -1)
    for keys in starts:
        begin = np.maximum(begin, _member(keys, lex[1][0]))
    odds = np.where(known, lex[0][1][at] if len(lex[0][1]) else 0, 0) + np.where(begin >= 0, lex[1][1][begin] if len(lex[1][1]) else 0, 0)
    hit = insult | known | (begin >= 0)
    second = _member(whole, you) >= 0
    near = np.zeros(len(whole), dtype=bool)
    for gap in range(1, 6):
        for a, b in ((slice(None, -gap), slice(gap, None)), (slice(gap, None), slice(None, -gap))):
            if len(whole) > gap:
                near[a] |= second[b] & (row[a] == row[b])
    near &= hit
    total = np.concatenate(([0], np.cumsum(hit)))
    first = np.searchsorted(row, np.arange(rows))
    window = total[1:] - total[np.maximum(np.arange(len(whole)) - 49, first[row])]
    most = np.zeros(rows)
    np.maximum.at(most, row, window)
    bytes_of = np.maximum(np.diff(offsets), 1)
    letter, inner = _LETTER[low], np.zeros(len(low), dtype=bool)
    same = np.zeros(len(low), dtype=bool)
    if len(low) > 2:
        inner[1:-1] = _MASK[low[1:-1]] & letter[:-2] & letter[2:]
        same[2:] = letter[2:] & (low[2:] < 128) & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
    capital, symbol = (data >= 65) & (data <= 90), CLASS[data] == 2
    cols = [np.log1p(n), per_row(insult), per_row(insult) / each, per_row(known), per_row(known) / each,
            per_row(begin >= 0), per_row(begin >= 0) / each, per_row(odds), per_row(odds) / each, per_row(near), per_row(near) / each,
            most, per_row_bytes(capital) / bytes_of, per_row_bytes(symbol) / bytes_of, per_row_bytes(data == 33) / bytes_of,
            per_row_bytes(inner) / each, per_row_bytes(same) / each]
    return np.stack(cols, axis=1)


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.7, folds: int = 3, held_fold: int = 1, max_rows: int = 12000,
                    words_kept: int = 400, beginnings_kept: int = 150, least: int = 4, trees: int = 20, depth: int = 4) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    ``docs`` needs doc_id and text, ``labels`` doc_id and toxic.  Labels of
    documents whose fold (crc32 of doc_id, modulo ``folds``) is ``held_fold``
    are never used.  Null and empty texts are scored as texts without words;
    a null doc_id is not held out and not trained on; rows that repeat a
    doc_id are scored one by one; null labels are ignored, of several the
    least counts; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_fold, F.lit(False))
    sample = stage(training_rows(labels, "toxic", ~held, max_rows).coalesce(1), "sample")      # max_rows rows
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(20))
    for_words = sample.where(part < 9)
    lex = lexicon(rows.join(F.broadcast(for_words), "doc_id"), words_kept, beginnings_kept, least)
    shared = docs.sparkSession.sparkContext.broadcast((lex, _hash_words(INSULTS), _hash_words(YOU)))

    def run(batches):
        for batch in batches:
            x = [dense(*shared.value, data, offsets) for _, _, data, offsets in text_chunks(batch.column(1))]
            x = np.concatenate(x) if x else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(len(NAMES)))], names=["doc_id", *NAMES])

    features = stage(rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in NAMES)), "features")
    result = ["doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")]
    if features.isEmpty():
        return features.withColumn("score", F.lit(0.0)).select(*result)
    assembler = VectorAssembler(inputCols=NAMES, outputCol="features")
    train = assembler.transform(features.join(F.broadcast(sample.where(part >= 9)), "doc_id")).select(
        "doc_id", "features", F.col("label").cast("double").alias("label"))
    train = stage(train.repartition(2, "doc_id").sortWithinPartitions("doc_id"), "train")
    if train.isEmpty():
        raise ValueError("no labelled document to train on")
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, seed=1).fit(train.where(part < 16))
    raw = vector_to_array("probability")[1]
    curve = IsotonicRegression(featuresCol="raw", predictionCol="calibrated").fit(
        gbt.transform(train.where(part >= 16)).select(raw.alias("raw"), "label"))
    known = gbt.transform(assembler.transform(features)).withColumn("raw", raw)
    # The curve has steps; a hundredth of the trees' own probability keeps the order inside a step.
    scored = curve.transform(known).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("calibrated") + 0.01 * F.col("raw"))))
    return scored.select(*result)

"""Document quality from random-indexing word vectors and a small network.

1. Every word (run of letters and digits, or of symbols, case kept) and
   every word *shape* (symbols or letters, capitals, length) has a sparse
   random index vector, a rule on its key.  The vector of a word is the sum
   of the index vectors of its neighbours (two to each side) over *all*
   documents.  Words are counted first: one that occurs twice or more and
   makes up at least ``share`` of all words has a row of its own, so the
   table grows with the corpus to at most 1 / ``share`` rows; rarer words
   share ``BUCKETS`` rows by hash.
2. Tasks add up the rows they meet, a grouped sum merges them.  Vectors are
   normalised, rid of the common direction and rounded to 8 bits; this table
   (40 bytes a row, 42 MB at most) is broadcast.
3. A document pools its words' vectors: means and mean squares, the mean of
   its shapes' vectors, and how alike neighbouring words are (which tells
   repetition).  One row of ``FEATURES`` numbers per document is staged.
4. A two-layer network is trained on at most ``max_rows`` labelled rows
   (those with the smallest hash of doc_id), and a temperature that
   calibrates its probabilities is fitted on a fifth of them that training
   does not see.
5. Every document is scored from its staged row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.storage import drop, stage
from cirro.llm.textops import Rolling, class_runs, mix, text_chunks

SHAPES = 64                                                 # the first rows of the table are shapes',
BUCKETS = 1 << 14                                           # the next ones buckets, then come frequent words
FIRST = SHAPES + BUCKETS
SHARE = 2.0**-20
TOTAL = -1                                                  # its count is that of all words
DIM = 32
NONZERO = 2
FEATURES = 3 * DIM + 5
CHUNK = 2 << 20                                             # bytes of text
SLICE = 1 << 17                                             # words whose neighbours are added up at once
UNIT = float(1 << 30)
SUMS = [f"s{i}" for i in range(DIM)]

_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, dtype=np.int64)
_LOWER[97:123] = 1


def index_vectors(frequent: np.ndarray) -> np.ndarray:
    """(rows, DIM) signed bytes: the index vectors of shapes and buckets (by number) and frequent words (by key)."""
    h = mix(np.concatenate((np.arange(FIRST, dtype=np.uint64), frequent)) + np.uint64(17))
    out, row = np.zeros((len(h), DIM), dtype=np.int8), np.arange(len(h))
    for k in range(NONZERO):
        place = (h >> np.uint64(8 * k) & np.uint64(DIM - 1)).astype(np.int64)
        out[row, place] += np.where(h >> np.uint64(60 + k) & np.uint64(1), -1, 1).astype(np.int8)
    return out


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, shape, row) of each word, in text order."""
    start, end, row, kind = class_runs(data, offsets)
    if not len(start):
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z
    key = Rolling(data).of(start, end)
    key[key < FIRST] += np.uint64(FIRST)
    key[key == 2**64 - 1] -= np.uint64(1)
    upper, lower = (np.concatenate(([0], np.cumsum(t[data]))) for t in (_UPPER, _LOWER))
    up, low = upper[end] - upper[start], lower[end] - lower[start]
    case = (up > 0) + 2 * (low > 0)                          # none, capitals, small, both
    length = np.minimum(7, np.log2(end - start).astype(np.int64) + (end - start > 1))
    return key, (kind - 1) * 32 + case * 8 + length, row


def frequent_words(rows: DataFrame, share: float = SHARE) -> np.ndarray:
    """The keys, ascending, of the words with rows of their own: at most 1 / ``share``."""
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), CHUNK):
                word, _, _ = word_keys(data, offsets)
                found, n = np.unique(word, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(found.view(np.int64), TOTAL)), pa.array(np.append(n, len(word)))], names=["word", "n"])

    counts = rows.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stage(counts, "words")
    total = counts.where(F.col("word") == TOTAL).select("n").first()
    if total is None:
        drop(counts)
        return np.zeros(0, dtype=np.uint64)
    found = counts.where((F.col("word") != TOTAL) & (F.col("n") >= share * total[0])).select("word").toArrow()
    drop(counts)
    return np.sort(found["word"].to_numpy().view(np.uint64))


def table_rows(word: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The table's row of each word: its own or its bucket's."""
    out = (word % np.uint64(BUCKETS)).astype(np.int64) + SHAPES
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, word), len(frequent) - 1)
        out = np.where(frequent[at] == word, at + FIRST, out)
    return out


def add_neighbours(out: np.ndarray, index: np.ndarray, own: np.ndarray, row: np.ndarray) -> None:
    """Adds to ``out`` the index vectors of the neighbours of ``own`` (table rows of words or shapes, in text order)."""
    n = len(own)
    for a in range(0, n, SLICE):
        lo, hi = max(0, a - 2), min(n, a + SLICE + 2)
        e = index[own[lo:hi]]
        near = np.zeros_like(e)
        for gap in (1, 2):
            if hi - lo > gap:
                same = (row[lo:hi - gap] == row[lo + gap:hi])[:, None]
                near[:-gap] += e[gap:] * same
                near[gap:] += e[:-gap] * same
        here = own[a:a + SLICE]
        order = np.argsort(here, kind="stable")
        begin = np.flatnonzero(np.diff(here[order], prepend=-1))
        out[here[order[begin]]] += np.add.reduceat(near[a - lo:a - lo + len(here)][order], begin, axis=0, dtype=np.int32)


def context_sums(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """word (its row in the table) and s0, s1, ...: summed index vectors of its neighbours over all texts.

    A task holds one sum of 128 bytes for each row of the table.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)          # 1 / SHARE keys at most

    def run(batches):
        index = index_vectors(shared.value)
        out = np.zeros((len(index), DIM), dtype=np.int32)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), CHUNK):
                word, shape, row = word_keys(data, offsets)
                for own in (table_rows(word, shared.value), shape):
                    add_neighbours(out, index, own, row)
        used = np.flatnonzero(out.any(axis=1))
        for a in range(0, len(used), 1 << 14):
            part = used[a:a + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(c.astype(np.int64)) for c in out[part].T)], names=["word", *SUMS])

    parts = rows.select("text").mapInArrow(run, "word long, " + ", ".join(f"{c} long" for c in SUMS))
    return parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in SUMS))


def _units(batch: pa.RecordBatch) -> np.ndarray:
    """The sums of a batch as unit vectors; zero where they cancel."""
    sums = np.stack([batch.column(1 + i).to_numpy() for i in range(DIM)], axis=1).astype(np.float64)
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.divide(sums, size, out=np.zeros_like(sums), where=size > 0)


def word_vectors(sums: DataFrame) -> DataFrame:
    """word and v (DIM signed bytes): unit vectors without the common direction."""
    def total(batches):
        out = np.zeros(1 + DIM, dtype=np.int64)
        for batch in batches:
            v = _units(batch)
            out[0] += np.count_nonzero(v.any(axis=1))
            out[1:] += np.rint(v * UNIT).astype(np.int64).sum(axis=0)                  # whole numbers: the same in any order
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=["n", *SUMS])

    parts = sums.mapInArrow(total, "n long, " + ", ".join(f"{c} long" for c in SUMS))
    row = parts.agg(*(F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).alias(c) for c in ("n", *SUMS))).first()
    common = np.array([float(x) for x in row[1:]]) / UNIT / max(float(row[0]), 1.0)

    def run(batches):
        for batch in batches:
            v = _units(batch)
            v[v.any(axis=1)] -= common
            size = np.linalg.norm(v, axis=1, keepdims=True)
            raw = np.rint(127 * np.divide(v, size, out=np.zeros_like(v), where=size > 1e-12)).astype(np.int8).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[i:i + DIM] for i in range(0, len(raw), DIM)], pa.binary())], names=["word", "v"])

    return sums.mapInArrow(run, "word long, v binary")


def pooled(table: np.ndarray, frequent: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) of a chunk of texts; rows without words are zero.  ``table``: the vectors as signed bytes."""
    word, shape, row = word_keys(data, offsets)
    word, ends = table_rows(word, frequent), np.searchsorted(row, np.arange(len(offsets) - 1), side="right")
    shapes = table[:SHAPES] / np.float32(127)
    begin = np.concatenate(([0], ends[:-1])).astype(np.int64)
    out = np.zeros((len(ends), FEATURES), dtype=np.float32)
    full = np.flatnonzero(ends > begin)
    for a in range(0, len(full), 256):                       # bounds the gathered vectors
        f = full[a:a + 256]
        lo, hi = begin[f[0]], ends[f[-1]]
        at, n = begin[f] - lo, (ends - begin)[f]
        size, row = n[:, None].astype(np.float32), np.repeat(np.arange(len(f)), n)
        w = table[word[lo:hi]] / np.float32(127)
        out[f, :DIM] = np.add.reduceat(w, at) / size
        out[f, DIM:2 * DIM] = np.add.reduceat(w * w, at) / size
        out[f, 2 * DIM:3 * DIM] = np.add.reduceat(shapes[shape[lo:hi]], at) / size
        for k, gap in enumerate((1, 2, 3)):
            alike = np.zeros(hi - lo, dtype=np.float32)
            if hi - lo > gap:
                alike[:-gap] = np.einsum("ij,ij->i", w[:-gap], w[gap:]) * (row[:-gap] == row[gap:])
            out[f, 3 * DIM + k] = np.add.reduceat(alike, at) / size[:, 0]
        out[f, 3 * DIM + 3], out[f, 3 * DIM + 4] = np.log1p(size[:, 0]), np.sqrt(1 / size[:, 0])
    return out


def word_table(docs: DataFrame, share: float = SHARE):
    """Broadcast (vectors, frequent words) of all texts: at most 1 / ``share`` + FIRST rows."""
    rows = docs.select("text")
    frequent = frequent_words(rows, share)
    sums = stage(context_sums(rows, frequent), "sums")
    found = word_vectors(sums).toArrow()
    drop(sums)
    table = np.zeros((FIRST + len(frequent), DIM), dtype=np.int8)
    table[found["word"].to_numpy()] = np.frombuffer(b"".join(found["v"].to_pylist()), np.int8).reshape(-1, DIM)
    return docs.sparkSession.sparkContext.broadcast((table, frequent))


def featured(docs: DataFrame, shared, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``features`` (binary, 32-bit floats) of every row.  ``shared``: that of ``word_table``."""
    def run(batches):
        for batch in batches:
            rows = []
            for _, _, data, offsets in text_chunks(batch.column(batch.num_columns - 1), CHUNK):
                raw = pooled(*shared.value, data, offsets).tobytes()
                rows += [raw[i:i + 4 * FEATURES] for i in range(0, len(raw), 4 * FEATURES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.binary())], names=[*keep, "features"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, features binary")


class Network:
    """Two layers with a temperature; trained by Adam on weighted cross-entropy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.temperature = 1.0
        self.p = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden),
                  rng.standard_normal((hidden, 1)) / np.sqrt(hidden), np.zeros(1)]
        held = rng.permutation(len(y)) < len(y) // 5 if len(y) >= 50 else np.zeros(len(y), bool)
        xt, yt = self._input(x[~held]), y[~held, None]
        moment, square, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(yt))
            for a in range(0, len(order), 128):
                xb, yb = xt[order[a:a + 128]], yt[order[a:a + 128]]
                h = np.maximum(xb @ self.p[0] + self.p[1], 0)
                d = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -40, 40))) - yb) / len(yb)
                dh = (d @ self.p[2].T) * (h > 0)
                step += 1
                rate = 3e-3 * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, m, s in zip(self.p, (xb.T @ dh + 1e-4 * self.p[0], dh.sum(0), h.T @ d + 1e-4 * self.p[2], d.sum(0)), moment, square):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * m / (np.sqrt(s) + 1e-8)
        if held.any():
            z, t = self.logit(x[held]), y[held]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _input(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (np.maximum(self._input(x) @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -40, 40)))


def fold(doc_id, parts: int):
    """crc32 of the id's decimal text, modulo ``parts``; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def training_rows(labels: DataFrame, label: str, usable, max_rows: int) -> DataFrame:
    """At most ``max_rows`` (doc_id, label): the smallest hashes of the usable doc_ids, one row each."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.min(label).alias("label"))
    return rows.orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(max_rows).select(F.col("doc_id").cast("long").alias("doc_id"), "label")


def feature_matrix(rows: list) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, FEATURES)


def fit(features: DataFrame, labels: DataFrame, usable, max_rows: int = 20000) -> Network:
    """Train on the labelled rows that ``usable`` (a condition on doc_id) allows."""
    sample = F.broadcast(training_rows(labels, "quality", usable, max_rows))            # max_rows rows
    # One row per doc_id, of rows that repeat one the least features: max_rows rows.
    rows = features.join(sample, "doc_id").groupBy("doc_id", "label").agg(F.min("features").alias("features")).select("features", "label").collect()
    if not rows:
        raise ValueError("no labelled document to train on")
    rows.sort(key=lambda r: (bytes(r[0]), r[1]))                                        # the same fit whatever the order
    return Network(feature_matrix([bytes(r[0]) for r in rows]).astype(np.float64), np.array([float(r[1]) for r in rows]))


def scored(features: DataFrame, net: Network, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``features`` and ``score``, the probability of label 1."""
    def run(batches):
        for batch in batches:
            x = feature_matrix(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(net.score(x))], names=[*keep, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.select(*keep).schema)
    return features.select(*keep, "features").mapInArrow(run, f"{fields}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, folds: int = 5, max_rows: int = 20000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality.  Labels
    of documents whose fold (crc32 of doc_id, modulo ``folds``) is 0 are never used.
    Null and empty texts are scored as texts without words; a null doc_id is
    not held out and not trained on; rows that repeat a doc_id are scored one
    by one; null labels are ignored, of several the least counts; other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = stage(featured(rows, word_table(rows), ["doc_id"]), "features")
    if features.isEmpty():
        return features.select("doc_id", F.lit(False).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    net = fit(features, labels, fold(F.col("doc_id"), folds) != 0, max_rows)
    out = scored(features, net, ["doc_id"])
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3, folds: int = 5, max_rows: int = 20000) -> DataFrame:
    """The documents that score ``cut`` or more, all their columns; training as in ``quality_scores``.

    No text is shuffled: the word table and the training rows come from
    passes over the texts, and the last pass filters them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.isEmpty():
        return docs
    words, usable = word_table(rows), fold(F.col("doc_id"), folds) != 0
    sample = F.broadcast(training_rows(labels, "quality", usable, max_rows).select("doc_id"))           # max_rows rows
    net = fit(featured(rows.join(sample, "doc_id", "left_semi"), words, ["doc_id"]), labels, usable, max_rows)
    column = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            good = [net.score(pooled(*words.value, data, offsets)) >= cut for _, _, data, offsets in text_chunks(batch.column(column), CHUNK)]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)

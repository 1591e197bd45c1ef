"""Exact removal of long byte strings that occur more than once in a corpus.

Prefix-free parsing, distributed.  A rolling hash of every ``GRAM`` bytes
picks triggers: the least hash among ``gap`` consecutive grams, so a
trigger depends only on the bytes around it and two triggers are never
further apart than ``gap``.  The trigger of the grams at [s, s + gap) is
inside the string that starts at s, hence equal strings have the same
trigger at the same place, and consecutive starts share one: the starts
with one trigger are a *phrase*.

1. Parse: one pass over the texts gives per phrase its document, first
   start, number of starts, the hash of the bytes that all its strings
   share (``core``) and of all bytes its strings touch (``body``).
   No text is shuffled.
2. Dictionary: phrases whose core occurs once hold no repeated string.  Of
   the others each distinct (core, body) is one dictionary phrase, counted;
   all strings of a phrase that occurs twice are repeated.
3. Only where a core has several bodies (the edges of repeated passages) is
   the order of the dictionary's suffixes needed, and of it only which
   suffixes are equal in their first ``length`` bytes.  The phrases' bytes
   are fetched once.  Each is cut at fixed distances from its trigger into
   blocks of ``BLOCK`` starts that go through step 2 again; strings of what
   blocks then remain are compared one by one, a 128-bit hash of the
   suffix's first ``length`` bytes standing for its rank.  Every dictionary
   phrase takes part once, however often it occurs.
4. Repeated starts, as ranges by document, meet the texts again; covered
   bytes are the union of [s, s + length).

All groups are counted by partial aggregation; a passage in a third of all
documents is one dictionary phrase.  Texts are shuffled twice, compressed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.storage import drop, stage
from cirro.llm.textops import CHUNK_BYTES, _TABLE, _TABLE2, Rolling, text_chunks

GRAM = 16
BLOCK = 32
ROW, ROW_FIELDS = ["doc", "text_hash"], "doc long, text_hash long"       # what a row is known by
NO_ID = -(1 << 63)


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, have = v, 1
    while have < width:
        add = min(have, width - have)
        out = np.minimum(out[:len(out) - add], out[add:])
        have += add
    return out


def phrases(data: np.ndarray, offsets: np.ndarray, length: int, gap: int):
    """(row, first start in the row, starts, trigger in the row) of the phrases of one chunk; and its hashes."""
    n = len(data)
    if n < length:
        return None
    roll = Rolling(data)
    grams = n - GRAM + 1
    at = np.arange(grams)
    h = roll.of(at, at + GRAM)
    place = (h & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)          # the leftmost of equal hashes
    trigger = (sliding_least(place, gap) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n - length + 1]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n - length + 1]
    whole = np.arange(n - length + 1) + length <= offsets[row + 1]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    stop = whole.copy()
    stop[:-1] &= ~whole[1:] | new[1:]
    last = np.flatnonzero(stop)
    return roll, row[first], first, last - first + 1, trigger[first]


def slices(data: np.ndarray, offsets: np.ndarray, length: int):
    """(shift, bytes, offsets): a chunk as it is, or a very long text in parts that share ``length - 1`` bytes."""
    if len(offsets) > 2 or len(data) <= 4 * CHUNK_BYTES:
        yield 0, data, offsets
        return
    for p in range(0, len(data) - length + 1, CHUNK_BYTES):
        part = data[p:p + CHUNK_BYTES + length - 1]
        yield p, part, np.array([0, len(part)])


def parse(docs: DataFrame, length: int, gap: int) -> DataFrame:
    """The phrases of all texts: ROW, lo, n, trigger (from lo), core, body (hashes)."""
    shared = length - gap + 1

    def run(batches):
        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for a, _, data, offsets in text_chunks(batch.column(2)):
                for shift, part, at in slices(data, offsets, length):
                    found = phrases(part, at, length, gap)
                    if found is None or not len(found[1]):
                        continue
                    roll, row, first, count, trigger = found
                    core = roll.of(trigger, trigger + shared)
                    body = Rolling(part, _TABLE2).of(first, first + count - 1 + length)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(x[a + row]) for x in ids), pa.array((first - at[row] + shift).astype(np.int32)),
                         pa.array(count.astype(np.int32)), pa.array((trigger - first).astype(np.int32)),
                         pa.array(core.view(np.int64)), pa.array(body.view(np.int64))],
                        names=[*ROW, "lo", "n", "trigger", "core", "body"])

    return docs.select(*ROW, "text").mapInArrow(run, f"{ROW_FIELDS}, lo int, n int, trigger int, core long, body long")


def compressed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``z``, the compressed bytes of the text."""
    def run(batches):
        import zstandard
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([pack.compress(t.as_buffer()) for t in batch.column(batch.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], z], names=[*keep, "z"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, z binary")


def phrase_bytes(edges: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """core, body, n, trigger, bytes: all that the strings of the phrases (ROW, lo, n...) touch."""
    spans = edges.groupBy(*ROW).agg(F.collect_list(F.struct("core", "body", "n", "trigger", "lo")).alias("spans"))
    joined = spans.join(compressed(docs, ROW), ROW).select("spans", "z")

    def run(batches):
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for spans, z in zip(batch.column(0), batch.column(1)):
                data, v = unpack.decompress(z.as_buffer()), spans.values
                cut = [data[a:a + n - 1 + length] for a, n in zip(v.field(4).to_pylist(), v.field(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(v.field(i) for i in range(4)), pa.array(cut, pa.binary())],
                                                 names=["core", "body", "n", "trigger", "bytes"])

    return joined.mapInArrow(run, "core long, body long, n int, trigger int, bytes binary")


def blocks(fetched: DataFrame, length: int) -> DataFrame:
    """core, body, from, n, c1, b1: the blocks of the phrases, with the hashes of their own core and body."""
    def run(batches):
        for batch in batches:
            core, body, n, trigger = (batch.column(i).to_numpy() for i in range(4))
            for a, b, data, offsets in text_chunks(batch.column(4)):
                size = n[a:b].astype(np.int64)
                e = np.repeat(np.arange(b - a), size)
                s = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size)
                block = (trigger[a:b][e] - s) // BLOCK
                new = np.ones(len(e), dtype=bool)
                new[1:] = (e[1:] != e[:-1]) | (block[1:] != block[:-1])
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(e)))
                e, s, block = e[at], s[at], block[at]
                shared = offsets[e] + trigger[a:b][e] - block * BLOCK                 # what all strings of the block hold
                c1 = Rolling(data).of(shared, shared - BLOCK + 1 + length)
                b1 = Rolling(data, _TABLE2).of(offsets[e] + s, offsets[e] + s + count - 1 + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core[a:b][e]), pa.array(body[a:b][e]), pa.array(s.astype(np.int32)), pa.array(count.astype(np.int32)),
                     pa.array(c1.view(np.int64)), pa.array(b1.view(np.int64))], names=["core", "body", "from", "n", "c1", "b1"])

    return fetched.mapInArrow(run, "core long, body long, from int, n int, c1 long, b1 long")


def suffix_ranks(wanted: DataFrame, fetched: DataFrame, length: int) -> DataFrame:
    """core, body, s, r1, r2: 128-bit hashes of the strings at the starts of the wanted blocks (core, body, from, n)."""
    spans = wanted.groupBy("core", "body").agg(F.collect_list(F.struct("from", "n")).alias("spans"))
    joined = spans.join(fetched, ["core", "body"]).select("core", "body", "spans", "bytes")

    def run(batches):
        for batch in batches:
            core, body = (batch.column(i).to_numpy() for i in (0, 1))
            for a, b, data, offsets in text_chunks(batch.column(3)):
                e, first, n = [], [], []
                for r in range(a, b):
                    v = batch.column(2)[r].values
                    first.append(v.field(0).to_numpy())
                    n.append(v.field(1).to_numpy())
                    e.append(np.full(len(v), r - a))
                e, first, n = (np.concatenate(x).astype(np.int64) for x in (e, first, n))
                s = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                e = np.repeat(e, n)
                at = offsets[e] + s
                ranks = [Rolling(data, t).of(at, at + length).view(np.int64) for t in (_TABLE, _TABLE2)]
                yield pa.RecordBatch.from_arrays([pa.array(core[a:b][e]), pa.array(body[a:b][e]), pa.array(s.astype(np.int32)), *map(pa.array, ranks)],
                                                 names=["core", "body", "s", "r1", "r2"])

    return joined.mapInArrow(run, "core long, body long, s int, r1 long, r2 long")


def dictionary(rows: DataFrame, core: str, body: str, at: list[str]) -> tuple[DataFrame, DataFrame]:
    """(every distinct (core, body) with its ``times`` and one place; those whose core has several bodies)."""
    entries = stage(rows.groupBy(core, body).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*at)).alias("at")), "dictionary")
    several = stage(entries.groupBy(core).agg(F.count(F.lit(1)).alias("bodies")).where("bodies > 1").select(core), "several")
    return entries, entries.join(several, core, "left_semi")


def repeated_starts(docs: DataFrame, length: int, gap: int) -> DataFrame:
    """(ROW, lo, n): ranges of starts whose string occurs elsewhere too.  ``docs``: ROW, text."""
    parsed = stage(parse(docs, length, gap), "parse")
    # Staged, so that a hot core's phrases can be split in the join.
    cores = stage(parsed.groupBy("core").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("core"), "cores")
    again = stage(parsed.join(cores, "core", "left_semi"), "again")
    drop(parsed)
    phrases_, edges = dictionary(again, "core", "body", [*ROW, "lo", "n", "trigger"])
    fetched = stage(phrase_bytes(edges.select("core", "body", "at.*"), docs, length), "phrases")
    cut = stage(blocks(fetched, length), "blocks")
    blocks_, open_ = dictionary(cut, "c1", "b1", ["core", "body", "from", "n"])
    ranks = stage(suffix_ranks(open_.select("at.*"), fetched, length), "ranks")
    # A rank's strings belong to one phrase each, so two of them are two phrases of the dictionary.
    twice = ranks.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("r1", "r2")
    single = ranks.join(twice, ["r1", "r2"], "left_semi").select("core", "body", F.col("s").alias("from"), F.lit(1).alias("n"))
    once = phrases_.where("times = 1").select("core", "body")
    part = cut.join(blocks_.where("times > 1").select("c1", "b1"), ["c1", "b1"], "left_semi").select("core", "body", "from", "n")
    # What is found at a dictionary phrase's first place holds for all its places.
    whole = phrases_.where("times > 1").select("core", "body", F.array(F.struct(F.lit(0).alias("from"), F.col("at.n").alias("n"))).alias("ranges"))
    parts = part.union(single).join(once, ["core", "body"], "left_semi").groupBy("core", "body").agg(
        F.collect_list(F.struct("from", "n")).alias("ranges"))
    marked = stage(whole.union(parts), "marked")
    for t in (ranks, cut, fetched, cores):
        drop(t)
    return again.select(*ROW, "lo", "core", "body").join(marked, ["core", "body"]).select(*ROW, "lo", F.explode("ranges").alias("r")).select(
        *ROW, (F.col("lo") + F.col("r.from")).alias("lo"), "r.n")


def covered(lo: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal (start, end) byte runs of the strings that start in the ranges [lo, lo + n)."""
    order = np.argsort(lo, kind="stable")
    start, end = lo[order].astype(np.int64), np.maximum.accumulate((lo + n - 1 + length)[order].astype(np.int64))
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def remove_repeats(docs: DataFrame, length: int = 400, gap: int = 320, with_kept: bool = True, words: int | None = None) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that starts anywhere else too.

    ``docs`` needs doc_id and text; texts are UTF-8 bytes, null is empty,
    strings never cross documents and are judged on the input.  Returns one
    row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    removed (array of start, end) and kept (binary); with ``words`` also
    n_shared, how many strings of so many words another document holds too
    (``passages``), which are not removed.  Rows that repeat a
    doc_id, or have none, are separate documents (a row is known by its id and the
    hash of its text; rows equal in both by their count); other columns are
    ignored; an empty table gives no rows.
    """
    if not max(GRAM, BLOCK) <= gap <= length - 2 * GRAM:
        raise ValueError("need max(GRAM, BLOCK) <= gap <= length - 2 * GRAM")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows equal in id and text are known by the same key; both find each other and are given back.
    rows = named.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("text_hash", F.xxhash64("text"))
    repeats = repeated_starts(rows, length, gap)
    # Each span once, however many rows are equal in id and text.
    by_row = stage(repeats.dropDuplicates([*ROW, "lo", "n"]).groupBy(*ROW).agg(F.collect_list(F.struct("lo", "n")).alias("spans")), "spans")
    joined = compressed(rows, ["doc_id", *ROW]).join(by_row, ROW, "left").select("doc_id", *ROW, "spans", "z")
    if words:
        from cirro.llm.passages import shared_strings
        shared = stage(shared_strings(rows, words, words * 3 // 4), "shared")
        joined = joined.withColumn("who", F.xxhash64(*ROW)).join(shared, "who", "left").select("doc_id", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"), "spans", "z")
    else:
        joined = joined.select("doc_id", F.lit(0).cast("long").alias("n_shared"), "spans", "z")

    def run(batches):
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for doc_id, shared, spans, z in zip(*batch.columns):
                data = unpack.decompress(z.as_buffer())
                start = end = np.zeros(0, np.int64)
                if spans.is_valid:
                    v = spans.values
                    start, end = covered(v.field(0).to_numpy(), v.field(1).to_numpy(), length)
                kept = b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)]))
                removed = [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())]
                for c, x in zip(out, (doc_id.as_py(), len(data), len(data) - len(kept), len(start),
                                      hashlib.sha256(kept).hexdigest(), *([shared.as_py()] if words else []), removed, kept)):
                    c.append(x)
                size += len(kept) * with_kept
                if size > CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
                    out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    fields = [("doc_id", "long", pa.int64()), ("n_bytes", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64()), ("kept_sha256", "string", pa.string()),
              *([("n_shared", "long", pa.int64())] if words else []),
              ("removed", "array<struct<start:long,end:long>>", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), *([("kept", "binary", pa.binary())] if with_kept else [])]
    names, types = [n for n, _, _ in fields], [t for _, _, t in fields]
    return joined.mapInArrow(run, ", ".join(f"{n} {kind}" for n, kind, _ in fields))

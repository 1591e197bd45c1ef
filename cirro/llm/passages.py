"""Passages of words that other documents hold too.

Prefix-free parsing as in ``suffix_dedup``, over words (runs without white space) in place of bytes:
triggers are the least hashes among ``gap`` consecutive grams of words, the
starts of ``least``-word strings with one trigger are a phrase, and equal strings have the same
trigger at the same place.

A phrase's ``core`` (the words that all its strings hold) that one document
holds alone ends the matter.  Of the others, phrases whose ``body`` (all words that
its strings touch) several documents hold are repeated as a whole.  Only where a
core has several bodies, at the edges of shared passages, are the strings
themselves compared, for one place of each body; the words are fetched from
the texts for these phrases alone.  All counts are partial before their
shuffles; a passage in a third of all documents is a few phrases, each counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.storage import drop, stage
from cirro.llm.suffix_dedup import ROW, ROW_FIELDS, compressed, sliding_least
from cirro.llm.textops import CHUNK_BYTES, CLASS, Rolling, mix, runs, text_chunks

GRAM = 6
_BASE, _INVERSE = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


class WordHashes:
    """Hashes of any runs of words of one chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        start, end, self.row = runs(CLASS[data] > 0, offsets)
        h = Rolling(data).of(start, end)
        up, down = (np.full(len(h) + 1, b, dtype=np.uint64) for b in (_BASE, _INVERSE))
        up[0] = down[0] = 1
        up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(h * up[:-1])))
        self.count = len(h)
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))      # of each row's words, and the end

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def word_phrases(w: WordHashes, least: int, gap: int):
    """(row, first start in the row, starts, core, body) of the phrases of one chunk."""
    n = w.count
    if n < least:
        return None
    at = np.arange(n - GRAM + 1)
    place = (w.of(at, at + GRAM) & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
    starts = n - least + 1
    trigger = (sliding_least(place, gap) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:starts]
    whole = w.row[:starts] == w.row[least - 1:]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (trigger[1:] != trigger[:-1]) | (w.row[1:starts] != w.row[:starts - 1])
    first = np.flatnonzero(new)
    stop = whole.copy()
    stop[:-1] &= ~whole[1:] | new[1:]
    last = np.flatnonzero(stop)
    t = trigger[first]
    return w.row[first], first - w.first[w.row[first]], last - first + 1, w.of(t, t + least - gap + 1), w.of(first, last + least)


def word_slices(data: np.ndarray, offsets: np.ndarray, least: int):
    """(words before, bytes, offsets): a chunk as it is, or a very long text in parts that share ``least - 1`` words."""
    n = len(data)
    if len(offsets) > 2 or n <= 4 * CHUNK_BYTES:
        yield 0, data, offsets
        return
    at, before, size = 0, 0, CHUNK_BYTES
    while at < n:
        end = min(n, at + size)
        while end < n and CLASS[data[end]] > 0:
            end += 1
        part = data[at:end]
        start, _, _ = runs(CLASS[part] > 0, np.array([0, len(part)]))
        more = len(start) - least + 1
        if end < n and more < 1:                                             # longer words than that
            size *= 2
            continue
        yield before, part, np.array([0, len(part)])
        if end == n:
            return
        before, at, size = before + more, at + int(start[more]), CHUNK_BYTES


def parse_words(docs: DataFrame, least: int, gap: int) -> DataFrame:
    """ROW, lo, n, core, body of all texts' phrases; ``who`` tells rows apart."""
    def run(batches):
        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for a, _, data, offsets in text_chunks(batch.column(2)):
                for before, part, at in word_slices(data, offsets, least):
                    found = word_phrases(WordHashes(part, at), least, gap)
                    if found is None or not len(found[0]):
                        continue
                    row, lo, n, core, body = found
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[a + row]) for x in ids), pa.array((lo + before).astype(np.int32)), pa.array(n.astype(np.int32)),
                                                      pa.array(core.view(np.int64)), pa.array(body.view(np.int64))], names=[*ROW, "lo", "n", "core", "body"])

    return docs.select(*ROW, "text").mapInArrow(run, f"{ROW_FIELDS}, lo int, n int, core long, body long")


def string_hashes(spans: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """string, who, multi: the hashes of the strings of the spans (ROW, lo, n, multi)."""
    by_row = stage(spans.groupBy(*ROW).agg(F.collect_list(F.struct("lo", "n", "multi")).alias("spans")), "word-spans")
    joined = compressed(docs, ROW).join(by_row, ROW).select(F.xxhash64(*ROW).alias("who"), "spans", "z")

    def run(batches):
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for who, spans_, z in zip(batch.column(0), batch.column(1), batch.column(2)):
                data = np.frombuffer(unpack.decompress(z.as_buffer()), np.uint8)
                lo, n, multi = (spans_.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                n = n.astype(np.int64)
                s, several = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(multi, n)
                for before, part, at in word_slices(data, np.array([0, len(data)]), least):
                    w = WordHashes(part, at)
                    own = (s >= before) & (s < before + w.count - least + 1)
                    k = s[own] - before
                    yield pa.RecordBatch.from_arrays([pa.array(w.of(k, k + least).view(np.int64)), pa.array(np.full(len(k), who.as_py())), pa.array(several[own])],
                                                     names=["string", "who", "multi"])

    return joined.mapInArrow(run, "string long, who long, multi boolean")


def shared_strings(docs: DataFrame, least: int = 48, gap: int = 36) -> DataFrame:
    """who, n_shared: how many of a row's strings of ``least`` words (counted by where they start) another row holds too.

    ``docs``: ROW, text; ``who`` is the hash of ROW; rows equal in id and text are one document here.  Rows without such a string are left out.
    """
    if not GRAM <= gap <= least - GRAM + 1:
        raise ValueError("need GRAM <= gap <= least - GRAM + 1")
    who = F.xxhash64(*ROW)
    parsed = stage(parse_words(docs, least, gap), "word-parse")
    several = F.min(who) != F.max(who)
    cores = stage(parsed.groupBy("core").agg(several.alias("s")).where("s").select("core"), "word-cores")
    again = stage(parsed.join(cores, "core", "left_semi"), "word-again")
    drop(parsed)
    bodies = stage(again.groupBy("core", "body").agg(several.alias("multi"), F.min(F.struct(*ROW, "lo", "n")).alias("at")), "word-bodies")
    whole = again.join(bodies.where("multi").select("core", "body"), ["core", "body"], "left_semi").dropDuplicates([*ROW, "lo"]).select(
        who.alias("who"), F.col("n").cast("long").alias("k"))
    edges = stage(bodies.groupBy("core").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("core"), "word-edges")
    strings = stage(string_hashes(bodies.join(edges, "core", "left_semi").select("at.*", "multi"), docs, least), "word-strings")
    twice = strings.groupBy("string").agg((F.max("multi") | (F.min("who") != F.max("who"))).alias("t")).where("t").select("string")
    single = strings.where("NOT multi").join(stage(twice, "word-twice"), "string", "left_semi").groupBy("who", "string").agg(F.count(F.lit(1)).alias("k")).select("who", "k")
    return whole.union(single).groupBy("who").agg(F.sum("k").alias("n_shared"))

"""Benchmark passages in documents, up to a number of edits, by the q-gram lemma.

A passage of m characters with at most e edits in it still shares
m - q + 1 - e * q of its character q-grams with the text, and these lie on
neighbouring diagonals (place in the text minus place in the passage).
For each document the shared q-grams are counted in diagonal bands, each
twice as wide as the edit budget and overlapping the next by half, so that
one band holds a whole match; bands that reach the bound are verified by
an alignment of the passage with the band's stretch of text alone.

Texts are compared in lower case, any white space as a blank, by code
point, so positions are those of the original text.  The edit budget is
``budget`` times the passage's length, less where the lemma needs it
(at least one shared q-gram must remain); passages shorter than q
characters share none and are searched for as they are.  All places of a
passage are given that don't overlap a better one.

Passages are read in blocks of ``block_chars`` characters; one block's texts are
the only data broadcast, and documents are scanned once per block.  Blocks follow
each other: the findings of one are staged before the next is read.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.storage import stage
from cirro.llm.textops import text_chunks

Q = 8                                                       # three doublings, see gram_hashes
TABLE_BITS = 22
_K = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288], dtype=np.uint32)


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points of lower-case UTF-8 bytes, white space as blanks."""
    c = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    low = c < 160
    space = low & (((c >= 9) & (c <= 13)) | ((c >= 28) & (c <= 31)) | (c == 133))
    if not low.all():
        high = np.flatnonzero(~low)
        space[high[np.isin(c[high], _SPACES)]] = True
    return np.where(space, np.uint32(32), c)


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """64-bit hashes of the Q code points from each position on."""
    n = len(c) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = c.astype(np.uint64) + np.uint64(7)
    two = x[:-1] * _K + x[1:] * np.uint64(0xD6E8FEB86659FD93)                 # pairs, then pairs of pairs
    four = two[:-2] * _K + (two[2:] ^ (two[2:] >> np.uint64(29)))
    h = four[:-4] * _K + (four[4:] ^ (four[4:] >> np.uint64(31)))
    h ^= h >> np.uint64(32)
    return h


def allowed(m: int, budget: float) -> int:
    """Edits allowed in a passage of m characters: the lemma leaves one shared q-gram at least."""
    return min(int(budget * m + 1e-9), (m - Q) // Q)


def distance(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best match of the whole pattern in the text, the first of equals, if within ``most``.

    One bit per pattern character, one step per text character.
    """
    m = len(pattern)
    where: dict[int, int] = {}
    for i, x in enumerate(pattern.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for j, y in enumerate(text.tolist()):
        eq = where.get(y, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        score += (right & top != 0) - (left & top != 0)
        right, left = right << 1 & full, left << 1 & full
        up, down = left | (full & ~((eq | down) | right)), right & (eq | down)
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


class Passages:
    """A block of passages, their q-grams and their bounds."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        text = _lower(pa.array([t for _, t in items], pa.large_string()))
        self.ids = [i for i, _ in items]
        self.text = [code_points(np.frombuffer(t.encode(), np.uint8)) for t in text.to_pylist()]
        self.size = np.array([len(t) for t in self.text], dtype=np.int64)
        self.short = [(i, t.tobytes()) for i, t in enumerate(self.text) if 0 < len(t) < Q]
        self.edits = np.array([max(0, allowed(int(m), budget)) for m in self.size], dtype=np.int64)
        self.bound = np.maximum(1, self.size - Q + 1 - self.edits * Q)
        hashes = [gram_hashes(t) for t in self.text]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else item
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.gram, self.first, self.times = np.unique(every[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.seen[self.gram & np.uint64((1 << TABLE_BITS) - 1)] = True

    def _short(self, c: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Every place of the passages shorter than a q-gram (of one passage, none over another)."""
        out, raw = [], c.tobytes()
        for i, t in self.short:
            at = raw.find(t)
            while at >= 0:
                step = 1
                if at % 4 == 0:
                    row = int(np.searchsorted(offsets, at // 4, side="right")) - 1
                    if at // 4 + len(t) // 4 <= offsets[row + 1]:
                        start = at // 4 - int(offsets[row])
                        out.append((row, self.ids[i], start, start + len(t) // 4, 0))
                        step = len(t)
                at = raw.find(t, at + step)
        return out

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, start, end, edits) of the matches of each passage in each row, none over a better one of the same passage."""
        if not len(data) or not len(self.ids):
            return []
        c = code_points(data)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        offsets = lead[offsets]
        return sorted(set(self._short(c, offsets) + self._long(c, offsets)))

    def _long(self, c: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        h = gram_hashes(c)
        p = np.flatnonzero(self.seen[h & np.uint64((1 << TABLE_BITS) - 1)]) if len(self.gram) else np.zeros(0, np.int64)
        at = np.searchsorted(self.gram, h[p])
        at[at == len(self.gram)] = 0
        same = self.gram[at] == h[p]
        p, at = p[same], at[same]
        row = np.searchsorted(offsets, p, side="right") - 1
        inside = p + Q <= offsets[row + 1]
        p, at, row = p[inside], at[inside], row[inside]
        # A passage cannot match a row that holds fewer of its q-grams than its bound.
        times = self.times[at]
        which = np.repeat(self.first[at] - np.cumsum(times) + times, times) + np.arange(times.sum())
        item, p, row = self.item[which], np.repeat(p, times), np.repeat(row, times)
        if not len(p):
            return []
        # Counts of the pairs that occur, not of all rows and passages.
        pair, which_pair, count = np.unique(row * len(self.ids) + item, return_inverse=True, return_counts=True)
        enough = (count >= self.bound[pair % len(self.ids)])[which_pair]
        item, p, row, which = item[enough], p[enough], row[enough], which[enough]
        if not len(p):
            return []
        wide = self.edits[item] + 1
        diagonal = p - offsets[row] - self.place[which] + self.size[item]         # not negative
        band = diagonal // wide
        # Half bands are counted; a band is a half band and the next, so it starts at a counted one or the one before.
        bands = int(band.max()) + 2
        halves, count = np.unique((row * len(self.ids) + item) * bands + band + 1, return_counts=True)
        starts = np.union1d(halves, halves - 1)
        held = np.zeros(len(starts), dtype=np.int64)
        held[np.searchsorted(starts, halves)] += count
        held[np.searchsorted(starts, halves - 1)] += count
        starts = starts[held >= self.bound[starts // bands % len(self.ids)]]
        places: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
        for r, i, b in zip(*(x.tolist() for x in (starts // bands // len(self.ids), starts // bands % len(self.ids), starts % bands - 1))):
            m, e = int(self.size[i]), int(self.edits[i])
            start, end = int(offsets[r]), int(offsets[r + 1])
            low = max(start, start + b * (e + 1) - m)
            stretch = c[low:min(end, start + (b + 2) * (e + 1) + e)]
            hit = distance(self.text[i], stretch, e)
            if hit:
                tail = distance(self.text[i][::-1], stretch[:hit[1]][::-1], e)
                places.setdefault((r, i), set()).add((hit[0], low - start + hit[1] - tail[1], low - start + hit[1]))
        out = []
        for (r, i), spans in places.items():
            kept: list[tuple[int, int]] = []
            for d, a, b in sorted(spans):
                at = bisect.bisect(kept, (a, b))
                if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or b <= kept[at][0]):
                    kept.insert(at, (a, b))
                    out.append((r, self.ids[i], a, b, d))
        return out


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The passages (item_id, text) in blocks of bounded size, by item_id."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text")
    items, size = [], 0
    for r in rows.toLocalIterator():
        if items and size + len(r["text"]) > block_chars:
            yield items
            items, size = [], 0
        items.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if items:
        yield items


_BUILT: dict[tuple, Passages] = {}


def built(name: str, items: list[tuple[int, str]], budget: float) -> Passages:
    """A block's q-gram tables, made in the worker; the last one is kept."""
    if (name, budget) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, budget] = Passages(items, budget)
    return _BUILT[name, budget]


def _block_by_block(start: DataFrame, benchmark: DataFrame, block_chars: int, work, put) -> DataFrame:
    """``put(so far, work(so far, broadcast block, name))`` for each block; all but the last are staged and their texts let go."""
    spark, out, held = start.sparkSession, start, None
    for items in blocks(benchmark, block_chars):
        if held is not None:
            out = stage(out, "passages")
            held.destroy()
        held = spark.sparkContext.broadcast(items)
        out = put(out, work(out, held, uuid.uuid4().hex))
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, budget: float = 0.1, block_chars: int = 1 << 20) -> DataFrame:
    """One row per document and place of a passage: doc_id, item_id, edits, start, end (code points).

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text.  Of
    places of one passage that overlap the one with fewest edits stays, of equal ones the
    first.  Null and empty texts hold nothing; very long texts are searched
    whole; rows that repeat a doc_id or an item_id
    are searched one by one and equal findings are given once; null doc_ids
    stay null; other columns are ignored; without documents or passages
    there are no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    none = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits long, start long, end long")

    def work(_, shared, name):
        def run(batches):
            passages = built(name, shared.value, budget)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for a, _, data, offsets in text_chunks(_lower(batch.column(1))):
                    found = [(ids[a + r], i, d, s, e) for r, i, s, e, d in passages.matches(data, offsets)]
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(5)],
                                                     names=["doc_id", "item_id", "edits", "start", "end"])

        return rows.mapInArrow(run, none.schema)

    return _block_by_block(none, benchmark, block_chars, work, lambda out, more: out.union(more)).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, budget: float = 0.1, block_chars: int = 1 << 20) -> DataFrame:
    """The documents that hold no passage, all their columns; rows are judged by their text alone."""
    column = docs.columns.index("text")

    def work(left, shared, name):
        def run(batches):
            passages = built(name, shared.value, budget)
            for batch in batches:
                good = np.ones(batch.num_rows, dtype=bool)
                for a, _, data, offsets in text_chunks(_lower(batch.column(column))):
                    for r, *_ in passages.matches(data, offsets):
                        good[a + r] = False
                yield batch.filter(pa.array(good))

        return left.mapInArrow(run, docs.schema)

    return _block_by_block(docs, benchmark, block_chars, work, lambda _, left: left)

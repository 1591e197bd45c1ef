"""Packing documents into fixed-length training sequences.

Shortest-pack-first over the length histogram: tokenise once, cut every
document into pieces of at most ``capacity`` ids, count pieces by length,
place lengths longest first (each into the least filled pack that has
room, whole counts at a time) and join the packing patterns back to the
pieces by their rank within the length.

Only the histogram (``capacity`` numbers) and the patterns reach the
driver.  Each placement step exhausts a length or a pattern, and a length
opens at most two, so there are at most ``4 * capacity`` patterns, whatever
the number of documents.

Cuts: a document gives full pieces of ``capacity`` ids and one remainder.
Remainders stay whole, but for a share of the documents (``fill_share``,
by the checksum of the remainder and the document's id) whose remainder is cut into small
pieces: ``capacity / 16`` ids each and the binary digits of the rest.
Placed last, these fill what the whole remainders leave open, also where
one length holds a large share of all documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirro.llm.byte_bpe import Known, UnitTokenizer
from cirro.llm.storage import stage
from cirro.llm.textops import give_back, restart_points, row_ranges

CHUNK = 4 << 20
KEPT = 1 << 20
PIECE_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SPECIAL = "<|endoftext|>"
_ENCODERS: dict[str, object] = {}


class ByteBpe:
    """The vocabulary's tokenizer, which sees each distinct unit of text (``restart_points``) once.

    Texts that hold the special token's string are encoded as they are.
    """

    def __init__(self, tokenizer_file: str):
        self.tokenizer = UnitTokenizer(tokenizer_file, special_as_text=False)
        self.slow = self.tokenizer.whole
        self.known = Known(lambda units: (units, self.tokenizer.lists(units)), KEPT)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin).  ``texts``: large strings without null, about a chunk."""
        _, offsets, values = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(values, np.uint8)[offsets[0]:offsets[-1]] if values is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        begin = restart_points(data, offsets)
        for r in np.flatnonzero(pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False)).tolist():
            begin[offsets[r] + 1:offsets[r + 1]] = False
        begin = np.flatnonzero(begin)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        (ids,), where = self.known.find(cut.dictionary)
        lists = ids.take(pa.array(where[cut.indices.to_numpy()]))
        at = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
        return lists.flatten().to_numpy(zero_copy_only=False), at[np.searchsorted(begin, offsets)].astype(np.int64)

    def check(self, text: str) -> None:
        if self.slow.encode(text, add_special_tokens=False).ids != self.encode(pa.array([text], pa.large_string()))[0].tolist():
            raise ValueError("a text's units have other ids than the text")


def encoder(files: tuple[str, str, str]) -> ByteBpe:
    if files[0] not in _ENCODERS:
        _ENCODERS[files[0]] = ByteBpe(files[0])
    return _ENCODERS[files[0]]


def cut_lengths(n: int, capacity: int, fill: bool) -> list[int]:
    """Piece lengths of a document of n ids, in text order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    if rest and fill:
        small = max(1, capacity // 16)
        out += [small] * (rest // small)
        rest %= small
        bit = 1 << rest.bit_length()
        while rest:
            bit >>= 1
            if rest & bit:
                out.append(bit)
                rest -= bit
    elif rest:
        out.append(rest)
    return out


def pieces(docs: DataFrame, files: tuple[str, str, str], end_id: int, capacity: int, fill_share: float) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    threshold = int(fill_share * 2**32)

    def run(batches):
        enc = encoder(files)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids_of = batch.column(0).to_pylist()
            texts = batch.column(1)
            out = ([], [], [], [], [])
            for first, last in row_ranges(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), CHUNK):
                flat, starts = enc.encode(texts.slice(first, last - first).cast(pa.large_string()).fill_null(""))
                for doc_id, a, b in zip(ids_of[first:last], starts.tolist(), starts[1:].tolist()):
                    ids = np.append(flat[a:b], end_id).astype("<u4")
                    n, at = len(ids), 0
                    last_crc = zlib.crc32(ids[n - n % capacity:].tobytes())
                    fill = zlib.crc32(str(doc_id).encode(), last_crc) < threshold
                    for length in cut_lengths(n, capacity, fill):
                        out[0].append(doc_id)
                        out[1].append(at)
                        out[2].append(length)
                        out[3].append(zlib.crc32(ids[at:at + length].tobytes()))
                        out[4].append(n)
                        at += length
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE_FIELDS)


def shortest_pack_first(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths longest first, number of packs) that hold the histogram's pieces.

    ``hist[l]`` is the number of pieces of length l.  Lengths are placed
    longest first; each goes to the least filled packs with room, one piece
    a pack; what then finds no room opens as few new packs as hold it.
    """
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        left = int(hist[length])
        while left:
            fill = min((f for f, p in packs.items() if p and f + length <= capacity), default=None)
            if fill is None:
                each = capacity // length
                for pattern, count in (((length,) * each, left // each), ((length,) * (left % each), 1)):
                    if pattern and count:
                        packs[sum(pattern)].append((pattern, count))
                break
            pattern, count = packs[fill].pop()
            used = min(count, left)
            if count > used:
                packs[fill].append((pattern, count - used))
            packs[fill + length].append((pattern + (length,), used))
            left -= used
    return [p for fill in sorted(packs) for p in packs[fill]]


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a pack, first sequence, offset), by length and rank."""
    rows, taken, sequence = [], defaultdict(int), 0
    for pattern, count in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            rows.append((length, taken[length], each, sequence, offset))
            taken[length] += each * count
            offset += each * length
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def ranked(df: DataFrame, key: str, order: list[str], bucket_rows: int) -> DataFrame:
    """Adds ``rank``: 0, 1, 2... within each key, in any order.

    The key has few values (piece lengths), so its counts are broadcast.  A
    key of any size is split into buckets of about ``bucket_rows`` rows by
    a hash of the row; rows are numbered within the bucket and moved by the
    rows of the buckets before it.
    """
    totals = F.broadcast(df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("_parts")))
    bucketed = df.join(totals, key).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_parts"))).drop("_parts")
    sizes = bucketed.groupBy(key, "_bucket").count()
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    return bucketed.withColumn("_row", F.row_number().over(inside)).join(starts, [key, "_bucket"]).withColumn(
        "rank", F.col("_before") + F.col("_row") - 1).drop("_bucket", "_row", "_before")


def pack(docs: DataFrame, files: tuple[str, str, str], end_id: int = 1, capacity: int = 2048,
         fill_share: float = 1 / 16, bucket_rows: int = 2000) -> DataFrame:
    """Pack every document; one row per piece.

    ``docs`` needs doc_id and text (other columns are ignored).  Null and
    empty texts hold the end id alone; a null doc_id stays null; rows that
    repeat a doc_id are packed one by one; an empty table gives no rows.
    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset.  Every sequence is filled without gaps from offset 0.
    """
    cut = stage(pieces(docs, files, end_id, capacity, fill_share), "pieces")
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in cut.groupBy("length").count().collect():     # at most `capacity` rows
        hist[length] = count
    slots = slot_table(shortest_pack_first(hist, capacity))
    shared = docs.sparkSession.sparkContext.broadcast(slots)          # bounded by capacity, see above

    def place(batches):
        s = shared.value
        key = s[:, 0] << 44 | s[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = s[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)],
                names=[*columns, "sequence_id", "offset"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    out = ranked(cut, "length", ["doc_id", "start", "ids_crc32", "doc_tokens"], bucket_rows)
    return out.select(*columns, "rank").mapInArrow(place, PIECE_FIELDS + ", sequence_id long, offset long")


def padding(packed: pd.DataFrame, capacity: int) -> int:
    """Padding ids of a packed table: none for sequences whose length is a power of two."""
    used = packed.groupby("sequence_id")["length"].sum().to_numpy()
    return int(sum(0 if n & (n - 1) == 0 else capacity - n for n in used.tolist()))

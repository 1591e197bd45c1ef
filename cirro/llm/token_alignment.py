"""Which tokens of two tokenizers cover the same bytes.

Every text, with a space in front, is encoded by a byte-level tokenizer (A)
and by a piece tokenizer (B).  Where tokens of both end at the same byte the
text is cut into groups; an A and a B token are *linked* if their byte
ranges overlap.  The corpus-wide number of links of a pair of ids tells how
good a link is.

The work on texts is a pipeline of Arrow operations on a chunk of rows.  Texts
are cut into units at blanks where both tokenizers start anew; each distinct
unit is encoded once, and what was encoded is kept in a table of bounded size.  The token lists are flattened with their parent indices, token lengths come from
the vocabulary, segmented cumulative sums give the byte at which each token
ends, and an Acero hash join on (document, end) keys, full outer, gives all
cuts of a document: each stretch between neighbouring cuts is one link, each
cut that both sides have ends a group.  ``Table.group_by`` counts the pairs of
each document and chunk.

Spark does the rest.  The chunk rows are one staged table; partial counts are
merged by a grouped sum; the pairs that a chunk holds meet the sums in a join
in which a frequent pair has one row per chunk, not per link; and each chunk
gets its answers back by a cogroup on its id.  A chunk holds about
``chunk_bytes`` of text.  A longer text is a chunk of its own and is encoded
in slices, cut at blanks between two letters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.byte_bpe import Known, UnitTokenizer
from cirro.llm.storage import stage
from cirro.llm.textops import give_back, restart_points, row_ranges

MARK = "▁"
SLICE = 1 << 20
KEPT = 1 << 19
SEPARATORS = (",", "|", ";", "")
_LOADED: dict[tuple[str, str], "Pair"] = {}


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        self.a = UnitTokenizer(a_file, special_as_text=True)
        self.a_bytes = self.a.bytes
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = pa.array([bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x([0-9A-F]{2})>", p)) else p.replace(MARK, " ").encode() for p in pieces], pa.large_binary())
        self.n_b = len(pieces)
        self.sliceable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.known = Known(self._encoded, KEPT)
        most = max(len(self.a_bytes), self.n_b)
        self.most, self.decimal = most, pa.array([f"{i}{s}" for s in SEPARATORS for i in range(most)], pa.large_binary())

    def _encoded(self, units: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
        """The units (which start with a blank), their token ids, and whether both give the unit's bytes."""
        texts = units.cast(pa.large_string()).to_pylist()
        a = self.a.lists(units).cast(pa.large_list(pa.int32()))
        b = pa.array(self.b.encode([u[1:] for u in texts], num_threads=1), pa.large_list(pa.int32()))
        same = [pc.equal(_joined(pc.list_flatten(x), _starts(x), v)[0], units) for x, v in ((a, self.a_bytes), (b, self.b_bytes))]
        return units, a, b, pc.and_(*same)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where units begin (``restart_points``): the piece tokenizer starts anew there, too, if no piece holds a mark after something else."""
        return np.flatnonzero(restart_points(data, offsets)) if self.sliceable else offsets

    def slices(self, text: str) -> list[str]:
        """The text in parts of about ``SLICE`` characters that can be encoded one by one (the blank before a part is left out)."""
        out, at = [], 0
        while self.sliceable and len(text) - at > 2 * SLICE:
            cut = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])").search(text, at + SLICE)
            if cut is None:
                break
            out.append(text[at:cut.start()])
            at = cut.end()
        return [*out, text[at:]]


def tokenizers(a_file: str, b_file: str) -> Pair:
    key = (a_file, b_file)
    if key not in _LOADED:
        _LOADED[key] = Pair(*key)
    return _LOADED[key]


def _starts(lists: pa.Array) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))))


def _joined(ids: pa.Array, starts: np.ndarray, vocabulary: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the bytes of each list's tokens, joined; where each token begins in all of them)."""
    taken = vocabulary.take(ids)
    _, offsets, values = taken.buffers()
    at = np.frombuffer(offsets, np.int64)[:len(ids) + 1]
    values = values if values is not None else pa.py_buffer(b"")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(at[starts].copy()), values]), at


class Alignment:
    """The tokens, groups and links of a list of texts; ``whole`` marks those whose bytes both tokenizers give back."""

    def __init__(self, pair: Pair, texts: pa.Array):
        self.pair, rows = pair, len(texts)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(rows, np.int64) for _ in range(4))
        self.strings: list[bytes] = [b""] * rows
        self.links = pa.table({"row": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        _, offsets, values = spaced.buffers()
        offsets, data = np.frombuffer(offsets, np.int64)[:rows + 1], np.frombuffer(values, np.uint8)
        begin = pair.units(data, offsets)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin), values]).dictionary_encode()
        (a, b, whole), known = pair.known.find(cut.dictionary)
        which = known[cut.indices.to_numpy()]
        first = np.searchsorted(begin, offsets)                          # of each row's units
        whole = whole.to_numpy(zero_copy_only=False)[which]
        self.whole = np.logical_and.reduceat(whole, first[:-1]) & (np.diff(offsets) > 1)
        if self.whole.any():
            of_row = np.repeat(self.whole, np.diff(first))
            kept = pa.array(which[of_row])
            at = np.concatenate(([0], np.cumsum(np.diff(first)[self.whole])))
            self._align(a.take(kept), b.take(kept), at, np.flatnonzero(self.whole))

    def _side(self, lists: pa.Array, at: np.ndarray, vocabulary: pa.Array, name: str) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Table]:
        """ids, starts by document, end of each token in all documents, and the table (doc, end, token)."""
        ids, starts = pc.list_flatten(lists), _starts(lists)[at]
        doc = pa.array(np.repeat(np.arange(len(at) - 1), np.diff(at))).take(pc.list_parent_indices(lists))
        total = pc.cumulative_sum(pc.binary_length(vocabulary).take(ids).cast(pa.int64()))
        ends = total.to_numpy()
        before = np.concatenate(([0], ends))[starts[:-1]]
        table = pa.table({"doc": doc, "end": pc.subtract(total, pa.array(before).take(doc)), name: pa.array(np.arange(len(ids)))})
        return ids, starts, ends, table

    def _align(self, a: pa.Array, b: pa.Array, at: np.ndarray, rows: np.ndarray) -> None:
        """``a``, ``b``: token lists of the units; ``at``: where each document's units begin; ``rows``: the documents' places."""
        pair = self.pair
        a_ids, a_starts, _, a_table = self._side(a, at, pair.a_bytes, "i")
        b_ids, b_starts, _, b_table = self._side(b, at, pair.b_bytes, "j")
        cuts = a_table.join(b_table, keys=["doc", "end"], join_type="full outer", use_threads=False).combine_chunks()
        key = (cuts["doc"].to_numpy() << 40) | cuts["end"].to_numpy()
        cuts = cuts.take(pa.array(np.argsort(key, kind="stable")))
        i, j = (cuts[c].combine_chunks() if isinstance(cuts[c], pa.ChunkedArray) else cuts[c] for c in ("i", "j"))
        both = pc.and_(i.is_valid(), j.is_valid()).to_numpy(zero_copy_only=False)
        doc = cuts["doc"].to_numpy()
        over_a, over_b = pc.fill_null_backward(i).to_numpy(zero_copy_only=False), pc.fill_null_backward(j).to_numpy(zero_copy_only=False)
        linked = a_ids.to_numpy()[over_a].astype(np.int64) * pair.n_b + b_ids.to_numpy()[over_b]
        links = pa.table({"row": rows[doc], "pair": linked}).group_by(["row", "pair"], use_threads=False).aggregate([([], "count_all")])
        self.links = links.rename_columns(["row", "pair", "times"]).sort_by("row")
        self.n_a[rows], self.n_b[rows] = np.diff(a_starts), np.diff(b_starts)
        self.n_links[rows] = np.bincount(doc, minlength=len(rows))
        self.n_groups[rows] = np.bincount(doc[both], minlength=len(rows))
        # Written out: the A ids of a group, then its B ids; each token knows its place and what follows it.
        last_a, last_b = over_a[both].astype(np.int64), over_b[both].astype(np.int64)
        of_a, of_b = (np.repeat(np.arange(len(last)), np.diff(last, prepend=-1)) for last in (last_a, last_b))
        place_a = np.arange(len(a_ids)) + np.concatenate(([0], last_b + 1))[of_a]
        place_b = np.arange(len(b_ids)) + last_a[of_b] + 1
        mark_a, mark_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        mark_b[b_starts[1:] - 1] = 3
        index = np.empty(len(a_ids) + len(b_ids), np.int64)
        index[place_a] = mark_a * pair.most + a_ids.to_numpy()
        index[place_b] = mark_b * pair.most + b_ids.to_numpy()
        text, _ = _joined(pa.array(index), a_starts + b_starts, pair.decimal)
        for row, s in zip(rows.tolist(), text):
            self.strings[row] = s.as_buffer()


def one(text: str) -> pa.Array:
    return pa.array([text], pa.large_string())


def _merged(parts: Iterable[Alignment]) -> tuple[list[int], str, pa.Table]:
    """Counts, digest and links of one text from its slices."""
    digest, sums, links = hashlib.sha256(), np.zeros(4, np.int64), None
    for n, part in enumerate(parts):
        digest.update(b";" * (n > 0))
        digest.update(part.strings[0])
        sums += [getattr(part, c)[0] for c in ("n_a", "n_b", "n_groups", "n_links")]
        both = part.links if links is None else pa.concat_tables([links, part.links])
        links = both.group_by(["row", "pair"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["row", "pair", "times"])
    return sums.tolist(), digest.hexdigest(), links


ALIGNED = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("chunk", pa.int64()),
                     ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("chunk_pairs", pa.list_(pa.int64())), ("chunk_times", pa.list_(pa.int64()))])
ALIGNED_DDL = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunk long, "
               "pairs array<long>, times array<long>, chunk_pairs array<long>, chunk_times array<long>")


def _lists(table: pa.Table, rows: int, column: str) -> pa.Array:
    """The values of a table sorted by row, as a list for each row."""
    at = np.searchsorted(table["row"].to_numpy(), np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), table[column].combine_chunks() if table.num_rows else pa.array([], pa.int64()))


def _chunk(ids: pa.Array, sums: list[np.ndarray], digests: list[str], links: pa.Table, chunk: int) -> pa.RecordBatch:
    rows = len(ids)
    whole = links.group_by(["pair"], use_threads=False).aggregate([("times", "sum")])
    first = [[], []] if rows == 0 else [[whole[c].to_numpy()] + [None] * (rows - 1) for c in ("pair", "times_sum")]
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(s, pa.int64()) for s in sums), pa.array(digests, pa.string()), pa.array(np.full(rows, chunk)), _lists(links, rows, "pair"),
         _lists(links, rows, "times"), *(pa.array(x, pa.list_(pa.int64())) for x in first)], schema=ALIGNED)


def align_tokenizers(docs: DataFrame, a_file: str, b_file: str, chunk_bytes: int = 2 << 20) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``docs`` needs doc_id and text.  ``n_best`` counts the links whose pair of
    ids is linked as often in the corpus as any pair with its B id (ties
    included), ``count_sum`` adds up how often the pairs of all links are
    linked.  Null and empty texts, and those whose bytes a tokenizer doesn't
    give back, have no tokens: zeros, and an empty digest.  Rows that repeat a
    doc_id, or have none, are texts of their own; special tokens in a text are
    plain text; very long texts are encoded whole, in slices; other columns
    are ignored; an empty table gives no rows.
    """
    def run(batches):
        pair, part, serial = tokenizers(a_file, b_file), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for start, end in row_ranges(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), chunk_bytes):
                own = texts.slice(start, end - start).cast(pa.large_string()).fill_null("")
                slices = pair.slices(own[0].as_py()) if len(own) == 1 else []
                if len(slices) > 1 and all(Alignment(pair, one(s)).whole[0] for s in slices):
                    numbers, digest, links = _merged(Alignment(pair, one(s)) for s in slices)
                    sums, digests = [np.array([x]) for x in numbers], [digest]
                else:
                    found = Alignment(pair, own)
                    sums, links = [found.n_a, found.n_b, found.n_groups, found.n_links], found.links
                    digests = [hashlib.sha256(s).hexdigest() if ok else "" for s, ok in zip(found.strings, found.whole)]
                yield _chunk(batch.column(0).slice(start, end - start), sums, digests, links, part << 32 | serial)
                serial += 1
        give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = stage(texts.mapInArrow(run, ALIGNED_DDL), "aligned")
    held = aligned.where(F.col("chunk_pairs").isNotNull()).select("chunk", F.explode(F.arrays_zip("chunk_pairs", "chunk_times")).alias("x")).select(
        "chunk", F.col("x.chunk_pairs").alias("pair"), F.col("x.chunk_times").alias("times"))
    counts = stage(held.groupBy("pair").agg(F.sum("times").alias("links")), "pair-counts")
    n_b = tokenizers(a_file, b_file).n_b
    b_id = F.pmod(F.col("pair"), F.lit(n_b)).alias("b_id")
    most = counts.groupBy(b_id).agg(F.max("links").alias("most"))                  # one row per B id: the vocabulary's size at most
    judged = counts.select("pair", "links", b_id).join(F.broadcast(most), "b_id").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    answers = held.select(F.col("chunk").alias("of"), "pair").join(judged, "pair").select("of", "pair", "links", "best")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.num_rows
        lists = left["pairs"].combine_chunks()
        flat = pa.table({"row": pc.list_parent_indices(lists).cast(pa.int64()), "pair": pc.list_flatten(lists), "times": pc.list_flatten(left["times"].combine_chunks())})
        met = flat.join(right.select(["pair", "links", "best"]), keys="pair", join_type="inner", use_threads=False)
        met = met.append_column("n_best", pc.multiply(met["times"], met["best"].cast(pa.int64()))).append_column("count_sum", pc.multiply(met["times"], met["links"]))
        by_row = met.group_by(["row"], use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
        out = np.zeros((2, rows), np.int64)
        out[:, by_row["row"].to_numpy()] = by_row["n_best_sum"].to_numpy(), by_row["count_sum_sum"].to_numpy()
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        return pa.table([*(left[c] for c in names[:5]), pa.array(out[0]), pa.array(out[1]), left["groups_sha256"]], names=names)

    return aligned.drop("chunk_pairs", "chunk_times").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(
        score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

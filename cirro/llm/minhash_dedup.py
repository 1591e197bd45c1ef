"""Near-duplicate classes of documents by order MinHash and banded alignment.

A document is the sequence of its word ``k``-grams (words: lower case,
letters and digits; ``k`` = 5).  Each of ``sketches`` hash functions labels
every k-gram by its occurrence number, takes the ``order`` least labelled
k-grams and keeps them in *text order*; their joint hash is one sketch
value.  Two documents agree in it with a probability near the ``order``-th
power of their similarity, and less where the k-grams are rearranged.

Similarity of two documents is that of their best alignment: with m k-grams
matched in order, m / (a + b - m), the ordered form of the Jaccard index.
Pairs of 0.8 or more are links.  At 0.8 and the defaults a pair shares no
sketch value, and may be missed, with a probability of 3.3e-8 if the texts are
long; drawing without replacement makes it more for short ones: 4.7e-6 where
4 of 5 k-grams match, 2.8e-7 for 8 of 10, 9.0e-8 for 16 of 20.

1. Texts with equal word sequences are one node (partial aggregation), so
   copies never meet each other.  Unlike texts with the same doc_id are
   different nodes.
2. Per sketch value the documents are compared with one of them only, the
   one that shares most values with others; verified links give components.
3. For what stage 2 leaves open: all documents that share a value with
   documents of other components meet again by an exact prefix
   filter.  Of their k-grams (labelled by occurrence) those that no other
   open document has cannot match; the rarest of the rest, as many as the
   similarity forces two alike documents to share one of, are joined.  Only
   pairs of different components are formed whose lengths, and the k-grams that
   either has left from the shared one on, allow the similarity.
4. Components (star contraction) give the class: its smallest doc_id.

Candidates are verified on staged k-gram hashes of the candidate documents
alone, by a bit-parallel longest common subsequence restricted to the
diagonal band that the similarity bound allows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirro.llm.graph import components
from cirro.llm.storage import drop, stage
from cirro.llm.textops import mix, shingle_hashes, text_chunks


def occurrence(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often the same hash came before in its row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    at = np.arange(len(h))
    out = np.empty(len(h), dtype=np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def order_minhash(h: np.ndarray, offsets: np.ndarray, sketches: int, order: int, seed: int = 5) -> np.ndarray:
    """(rows, sketches) values; rows without k-grams hold zeros.  A row of fewer than ``order`` k-grams uses all of them."""
    rows = len(offsets) - 1
    out = np.zeros((rows, sketches), dtype=np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    begin = offsets[:-1][full]
    size = np.diff(offsets)[full]
    row = np.repeat(np.arange(len(full)), size)
    label = mix(h + mix(occurrence(h, offsets).astype(np.uint64) + np.uint64(seed)))
    salts = np.random.default_rng(seed).integers(1, 1 << 63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    largest = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i, salt in enumerate(salts):
        v = label * salt
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        places = []
        for _ in range(order):
            least = np.minimum.reduceat(v, begin)
            hit = np.flatnonzero(v == least[row])
            first = np.ones(len(hit), dtype=bool)
            first[1:] = row[hit[1:]] != row[hit[:-1]]
            hit = hit[first]                                     # one place a row, as labels are distinct
            done = v[hit] == largest
            v[hit] = largest
            places.append(np.where(done, np.iinfo(np.int64).max, hit))
        places = np.sort(np.stack(places), axis=0)               # text order
        value = np.full(len(full), np.uint64(i + 1))
        for p in places:
            there = p < len(h)
            value = np.where(there, mix(value * np.uint64(0x9E3779B97F4A7C15) + h[np.where(there, p, 0)]), value)
        out[full, i] = value
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Ordered similarity of two k-gram sequences, or 0 if it is under ``least``.

    A common subsequence of m items leaves len(a) - m and len(b) - m items out,
    so matches lie in a diagonal band of known width; rows of the band are
    integers with a bit for each position (a zero bit: the subsequence grows here).
    """
    na, nb = len(a), len(b)
    need = -int(-(least * (na + nb) / (1 + least) - 1e-9) // 1)
    if min(na, nb) < max(need, 1):
        return 0.0
    same = a[:min(na, nb)] == b[:min(na, nb)]
    head = len(same) if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    tail = 0
    if short:
        same = a[::-1][:short] == b[::-1][:short]
        tail = short if same.all() else int(np.argmin(same))
        a, b = a[:len(a) - tail], b[:len(b) - tail]
    m = head + tail
    if len(a) and len(b):
        band = max(na, nb) - need                                # |i - j| of any match of a good alignment
        place: dict[int, list[int]] = {}
        for i, x in enumerate(a.tolist()):
            place.setdefault(x, []).append(i)
        base, top, v = 0, min(len(a), band + 1), 0
        v = (1 << top) - 1                                       # positions base .. top - 1
        for j, y in enumerate(b.tolist()):
            low, high = max(0, j - band), min(len(a), j + band + 1)
            if low >= len(a):
                break
            if low > base:
                gone = v & ((1 << (low - base)) - 1)
                m += (low - base) - gone.bit_count()
                v >>= low - base
                base = low
            if high > top:
                v |= ((1 << (high - top)) - 1) << (top - base)
                top = high
            hits = place.get(y)
            if hits:
                u = 0
                for p in hits:
                    if low <= p < high:
                        u |= 1 << (p - base)
                u &= v
                if u:
                    v = ((v + u) | (v - u)) & ((1 << (top - base)) - 1)
        m += (top - base) - v.bit_count()
    s = m / (na + nb - m)
    return s if s >= least - 1e-12 else 0.0


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def sketch(docs: DataFrame, k: int, sketches: int, order: int) -> DataFrame:
    """doc_id, t, n (k-grams), f1, f2 (128-bit hash of the k-gram sequence), values (array) of the rows (doc_id, t, text) with words."""
    def run(batches):
        for batch in batches:
            ids, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for a, b, data, offsets in text_chunks(_lower(batch.column(2))):
                h, at = shingle_hashes(data, offsets, k)
                values = order_minhash(h, at, sketches, order)
                n = np.diff(at)
                keep = np.flatnonzero(n)
                if not len(keep):
                    continue
                nth = np.arange(len(h), dtype=np.uint64) - np.repeat(at[:-1], n).astype(np.uint64)
                prints = [np.add.reduceat(mix(h ^ mix(nth + np.uint64(s))), at[:-1][keep]).view(np.int64) for s in (101, 202)]
                lists = pa.ListArray.from_arrays(np.arange(len(keep) + 1, dtype=np.int32) * sketches,
                                                 pa.array(values[keep].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][keep]), pa.array(t[a:b][keep]), pa.array(n[keep].astype(np.int32)), *map(pa.array, prints), lists],
                                                 names=["doc_id", "t", "n", "f1", "f2", "values"])

    return docs.mapInArrow(run, "doc_id long, t long, n int, f1 long, f2 long, values array<long>")


def sequences(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node and grams (binary, 64-bit hashes) of the k-gram sequence, of the ``nodes`` (doc_id, t, node); one row each.

    Texts are shuffled compressed.
    """
    def shrink(batches):
        import zstandard
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([pack.compress(x.as_buffer()) for x in batch.column(2).fill_null("")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z], names=["doc_id", "t", "z"])

    def run(batches):
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = batch.column(0)
            text = pa.array([unpack.decompress(z.as_buffer()).decode() for z in batch.column(1)], pa.large_string())
            for a, b, data, offsets in text_chunks(_lower(text)):
                h, at = shingle_hashes(data, offsets, k)
                raw = h.tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([raw[8 * x:8 * y] for x, y in zip(at[:-1], at[1:])], pa.binary())],
                                                 names=["node", "grams"])

    small = docs.mapInArrow(shrink, "doc_id long, t long, z binary").join(nodes, ["doc_id", "t"])
    return small.dropDuplicates(["doc_id", "t"]).select("node", "z").mapInArrow(run, "node long, grams binary")


def verified(pairs: DataFrame, grams: DataFrame, least: float) -> DataFrame:
    """The (a, b) pairs whose alignment reaches ``least``."""
    left = grams.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = grams.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            good = [aligned(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least) > 0
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def labelled(nodes: DataFrame, grams: DataFrame) -> DataFrame:
    """rep and one row per k-gram of it: 32 bits of the hash of the k-gram and its occurrence number.

    A chance meeting of two k-grams only makes the filter admit more.
    """
    joined = grams.withColumnRenamed("node", "rep").join(nodes, "rep", "left_semi").select("rep", "grams")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)]
                size = np.array([len(x) for x in raw])
                h = np.concatenate(raw)
                g = mix(h + mix(occurrence(h, np.concatenate(([0], np.cumsum(size)))).astype(np.uint64)))
                at = pa.array(np.repeat(np.arange(len(raw)), size))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array((g >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["rep", "g"])

    return joined.mapInArrow(run, "rep long, g int")


def prefix_pairs(nodes: DataFrame, grams: DataFrame, least: float) -> DataFrame:
    """(a, b) of different components ``c`` that may reach ``least``: an exact filter.

    Alike documents share ``least`` of either's k-grams, so one of the rarest
    n - ceil(least * n) + 1 of each, and from the first they share on, either
    has as many left as must match.  Per k-gram, only documents outside
    its most frequent component look for partners.
    """
    rows = stage(labelled(nodes, grams), "grams")
    often = rows.groupBy("g").agg(F.count(F.lit(1)).cast("int").alias("f")).where("f > 1")
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("f", "g"))
    most = F.count(F.lit(1)).over(Window.partitionBy("rep"))
    found = rows.join(often, "g").withColumn("nth", nth).withColumn("most", most).join(nodes, "rep")
    need = F.ceil(F.lit(least) * F.col("n") - 1e-9)
    prefix = found.where((F.col("most") >= need) & (F.col("nth") <= F.col("most") - need + 1)).select(
        "g", "rep", "n", "c", (F.col("most") - F.col("nth") + 1).alias("k"))
    prefix = stage(prefix, "prefix")
    drop(rows)
    by_class = prefix.groupBy("g", "c").agg(F.count(F.lit(1)).alias("size"))
    major = by_class.groupBy("g").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("size", "c"))["c"].alias("major")).where("classes > 1")
    open_ = prefix.join(major.drop("classes"), "g")
    other = open_.select("g", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("k").alias("k2"))
    common = F.least("k", "k2")
    pairs = open_.where("c != major").join(other, "g").where(
        (F.col("c") != F.col("c2")) & ((F.col("c2") == F.col("major")) | (F.col("c") < F.col("c2")))
        & (common >= F.lit(least) * (F.col("n") + F.col("n2") - common) - 1e-9))
    return pairs.select(F.greatest("rep", "rep2").alias("a"), F.least("rep", "rep2").alias("b")).distinct()


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def text_classes(docs: DataFrame, least: float = 0.8, k: int = 5, sketches: int = 24, order: int = 3) -> DataFrame:
    """One row per doc_id and text with words: doc_id, t (hash of the text), class (a node), class_id, n_grams, class_size.

    Nodes are doc_ids; where rows that share a doc_id have different texts,
    hashes of doc_id and text.
    """
    rows = _hashed(docs)
    sketched = stage(sketch(rows.where("doc_id IS NOT NULL"), k, sketches, order), "sketch")
    clash = sketched.groupBy("doc_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo < hi")
    clash = stage(clash.select("doc_id", F.lit(True).alias("clash")), "clash")
    named = sketched.join(clash, "doc_id", "left").withColumn(
        "node", F.when(F.col("clash"), F.xxhash64("doc_id", "t")).otherwise(F.col("doc_id")))
    groups = named.groupBy("f1", "f2").agg(F.min("node").alias("rep"), F.first("n").alias("n"), F.first("values").alias("values"),
                                           F.count(F.lit(1)).alias("copies"))
    reps = stage(groups, "reps")
    same = named.join(reps.where("copies > 1").select("f1", "f2", "rep"), ["f1", "f2"]).where("node != rep").select(
        F.col("node").alias("a"), F.col("rep").alias("b"))
    same = stage(same, "copies")
    counts = named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("t").alias("t"), F.max("n").alias("n_grams"))
    counts = stage(counts, "counts")
    drop(sketched)
    drop(clash)
    values = reps.select("rep", "n", F.explode("values").alias("v"))                       # a value holds its function's number
    sizes = values.groupBy("v").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = stage(values.join(sizes, "v"), "buckets")
    drop(reps)
    degree = met.groupBy("rep").agg(F.sum("size").alias("degree"))
    best = F.max(F.struct(F.col("degree"), (-F.col("rep")).alias("low")))
    hubs = met.join(degree, "rep").groupBy("v").agg((-best["low"]).alias("hub"))
    shared = stage(met.join(hubs, "v"), "buckets")
    drop(met)
    stars = shared.where("rep != hub").select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct()
    stars = stage(stars, "stars")
    nodes = counts.select("doc_id", "t", "node").join(shared.select(F.col("rep").alias("node")), "node", "left_semi")
    grams = stage(sequences(rows, nodes, k), "grams")
    links = stage(verified(stars, grams, least), "links")
    first = components(links)
    # Buckets whose documents are not yet one component.
    member = shared.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    mixed = member.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("v")
    left = member.join(mixed, "v", "left_semi").select("rep", "n", "c").distinct()
    left = stage(left, "open")
    pairs = stage(prefix_pairs(left, grams, least).join(stars, ["a", "b"], "left_anti"), "pairs")
    more = stage(verified(pairs, grams, least), "links")
    trees = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    classes = components(trees.union(more).union(same)).select("node", F.col("component").alias("class"))
    info = counts.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    sizes = info.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    for t in (left, shared):
        drop(t)
    return info.join(sizes, "class").select("doc_id", "t", "class", "class_id", "n_grams", "class_size")


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document: doc_id, class_id, kept, n_grams, class_size.

    ``docs`` needs doc_id and text; ``parameters`` are those of ``text_classes``.
    ``class_id`` is the smallest doc_id that links reach, ``kept`` marks that
    document.  Texts without words (null, empty) are alike to nothing, nor are
    rows without doc_id; both are kept.  Texts of fewer than ``k`` words are
    one gram of all their words.  Rows that repeat a doc_id come back as often
    as they came, each with the class of its own text: two classes have one
    class_id if unlike texts share that doc_id.  ``class_size`` counts
    different (doc_id, text).  Other columns are ignored; an empty table gives
    no rows.
    """
    out = _hashed(docs).select("doc_id", "t").join(text_classes(docs, **parameters), ["doc_id", "t"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                      F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
                      F.coalesce("n_grams", F.lit(0)).cast("long").alias("n_grams"),
                      F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without near duplicates of a kept one, all columns: one row of each class.

    Rows without doc_id, and rows whose text has no words, stay.  Unlike
    texts that share a doc_id are judged one by one.
    """
    classes = text_classes(docs, **parameters)
    info = classes.select(F.col("doc_id").alias("_id"), F.col("t").alias("_text"), F.col("class").alias("_class"),
                          (F.col("class_id") == F.col("doc_id")).alias("_kept"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_t"))
    joined = rows.join(info, (F.col("_doc") == F.col("_id")) & (F.col("_t") == F.col("_text")), "left").where("_kept IS NULL OR _kept")
    # Rows of the smallest doc_id whose texts are alike: one of them stays.
    nth = F.row_number().over(Window.partitionBy("_class", F.when(F.col("_kept").isNull(), F.xxhash64("row"))).orderBy(F.xxhash64("row.text")))
    return joined.withColumn("_nth", nth).where("_kept IS NULL OR _nth = 1").select("row.*")

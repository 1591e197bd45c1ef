"""Phrases of two to four words that stick together, by vertical partitioning.

The suffixes of a corpus (here: up to ``DEPTH`` words from every word of a
piece on) are dealt out by their prefix, so that each group's share of the
suffix tree fits into a task's memory and is built alone:

1. Prefixes of one word are counted, with their strings (``dictionary``).
   Words under ``min_count`` close their branch: no phrase holds them.
2. Prefixes of two words are counted where both words are frequent
   (``prefixes``); pairs under ``min_count`` close theirs.
3. The suffixes that remain go to the group of their prefix.  A prefix with
   more than ``split`` suffixes is extended to the full depth, where a group is a
   single leaf.  A task reads its prefixes in order and builds the depth-truncated
   subtrees of as many at a time as fit into ``MEMORY`` rows: a sort of
   their suffixes, and leaf totals added up to the inner nodes.  Leaves of
   extended prefixes are added up by a grouped sum.

Suffixes are counted per chunk of text before they are shuffled, so repeated
passages cost a row per chunk.  Words are 64-bit hashes of language and
word; that no two words share one is checked on the whole dictionary, and
another seed is taken if some do.  Which words and pairs are frequent is told
to the passes over the texts by a bitmap of at most 2^28 bits (32 MiB): it may
let more pass, never less.  Extended prefixes are at most 2^20, by ``split``.

Cuts, scores, covering phrases and ranks are joins and aggregates over the
table of frequent phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirro.llm.storage import drop, stage
from cirro.llm.textops import Rolling, byte_table, mix, runs, text_chunks

DEPTH = 4
CHUNK = 1 << 20
MEMORY = 1 << 18
H = [f"h{i}" for i in range(1, DEPTH + 1)]
_CUT = np.zeros(256, dtype=bool)
_CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_CUT
_WORD[[32, 9]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def parts(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(own, bytes, offsets): a chunk, or a very long text in parts.

    Words that start before ``own`` belong to the part; ``DEPTH - 1`` words after it are there to be read on.
    """
    n = len(data)
    if len(offsets) > 2 or n <= 2 * limit:
        yield n, data, offsets
        return
    at = 0
    while at < n:
        own = min(n, at + limit)
        while own < n and _WORD[data[own]]:                              # a word is never cut
            own += 1
        end, more = own, 256
        while end < n:
            end = min(n, own + more)
            _, ends, _ = runs(_WORD[data[own:end]], np.array([0, end - own]))
            if len(ends) >= DEPTH:                                       # the last one may be cut
                end = own + int(ends[DEPTH - 2])
                break
            more *= 2
        yield own - at, data[at:end], np.array([0, end - at])
        at = own


class Words:
    """The words of a part of text: hash (with the language), row, and whether the next word is in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: np.ndarray, own: int, seed: int):
        self.low = _LOWER[data]
        self.start, self.end, self.row = runs(_WORD[self.low], offsets)
        h = mix(Rolling(self.low, byte_table(100 + seed)).of(self.start, self.end) ^ languages[self.row])
        self.hash = np.where(h == 0, np.uint64(1), h)                    # 0 is "no word"
        piece = np.concatenate(([0], np.cumsum(_CUT[self.low])))[self.start]
        self.goes_on = np.zeros(len(self.start), dtype=bool)
        self.goes_on[:-1] = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])
        self.own = self.start < own

    def ahead(self, values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(values)
        out[:len(values) - by] = values[by:]
        return out


def _language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _word_parts(batches, seed: int):
    """(language of each row, its Words) of the parts of Arrow batches (lang, text)."""
    for batch in batches:
        lang = batch.column(0).to_pylist()
        code = {x: _language_hash(x) for x in set(lang)}
        hashes = np.array([code[x] for x in lang], dtype=np.uint64)
        for a, b, data, offsets in text_chunks(batch.column(1), CHUNK):
            for own, part, at in parts(data, offsets, CHUNK):
                yield lang[a:b], Words(part, at, hashes[a:b], own, seed)


def totals(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows with their weights added up.  (Rows whose hashes collide may come more than once.)"""
    if not len(weights):
        return columns, weights
    key = columns[0]
    for c in columns[1:]:
        key = together(key, c)
    order = np.argsort(key, kind="stable")
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(weights[order], at)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def dictionary(texts: DataFrame, seed: int) -> DataFrame:
    """lang, word, h, n of all words."""
    def run(batches):
        for lang, w in _word_parts(batches, seed):
            own = np.flatnonzero(w.own)
            h, first, n = np.unique(w.hash[own], return_index=True, return_counts=True)
            raw, at = w.low.tobytes(), own[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang[r] for r in w.row[at].tolist()], pa.string()),
                 pa.array([raw[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist())], pa.string()),
                 _signed(h), pa.array(n.astype(np.int64))], names=["lang", "word", "h", "n"])

    return texts.mapInArrow(run, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


class Bitmap:
    """Hashes that may be in a table: one bit of at most 2^28 each."""

    def __init__(self, hashes: DataFrame, column: str):
        size = min(28, max(16, (16 * hashes.count()).bit_length()))
        self.shift = np.uint64(64 - size)
        place = F.shiftrightunsigned(F.col(column), 64 - size)
        words = hashes.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - size}) & 63 as int))").alias("bit")).groupBy(
            "word").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.words = np.zeros(1 << (size - 6), dtype=np.int64)
        self.words[words["word"].to_numpy()] = words["bits"].to_numpy()

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.words.view(np.uint64)[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def prefixes(texts: DataFrame, frequent, seed: int) -> DataFrame:
    """h1, h2, n of the pairs of words that may both be frequent.  ``frequent``: a broadcast Bitmap of words."""
    def run(batches):
        known = frequent.value
        for _, w in _word_parts(batches, seed):
            good = known.holds(w.hash)
            at = np.flatnonzero(w.own & w.goes_on & good & w.ahead(good, 1))
            (h1, h2), n = totals([w.hash[at], w.hash[at + 1]], np.ones(len(at), np.int64))
            yield pa.RecordBatch.from_arrays([_signed(h1), _signed(h2), pa.array(n)], names=["h1", "h2", "n"])

    return texts.mapInArrow(run, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def suffixes(texts: DataFrame, pairs, extended, seed: int) -> DataFrame:
    """group, hot, h1 to h4, n of the suffixes of three words or more (h4 0: three) of which all pairs may be frequent.

    ``pairs``: a broadcast Bitmap of pairs; ``extended``: a broadcast sorted array, the hashes of prefixes
    that are extended to the full depth (hot).
    """
    def run(batches):
        known, long_ones = pairs.value, extended.value
        for _, w in _word_parts(batches, seed):
            pair = together(w.hash, w.ahead(w.hash, 1))
            good = w.goes_on & known.holds(pair)
            at = np.flatnonzero(w.own & good & w.ahead(good, 1))
            last = np.where(w.ahead(good, 2)[at], w.ahead(w.hash, 3)[at], np.uint64(0))
            h, n = totals([w.hash[at], w.hash[at + 1], w.hash[at + 2], last], np.ones(len(at), np.int64))
            group = together(h[0], h[1])
            hot = np.isin(group, long_ones)
            group = np.where(hot, together(group, together(h[2], h[3])), group)
            yield pa.RecordBatch.from_arrays([_signed(group), pa.array(hot), *map(_signed, h), pa.array(n)], names=["group", "hot", *H, "n"])

    return texts.mapInArrow(run, "group long, hot boolean, h1 long, h2 long, h3 long, h4 long, n long")


def subtree(columns: list[np.ndarray], n: np.ndarray) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(depth, path, total) of the nodes at full depth and one above, from suffixes and their counts.

    Suffixes are sorted; equal ones are a leaf; a leaf's total counts for the node above it.
    """
    order = np.lexsort(columns[::-1])
    path, total = [c[order] for c in columns], n[order]
    for depth in (DEPTH, DEPTH - 1):
        new = np.zeros(len(total), dtype=bool)
        new[:1] = True
        for c in path[:depth]:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        path, total = [c[at] for c in path], np.add.reduceat(total, at)
        yield depth, path, total


def subtrees(dealt: DataFrame, min_count: int) -> DataFrame:
    """hot, h1 to h4, n: frequent nodes of three words (h4 0) and four, and of extended prefixes all leaves."""
    names = ["group", "hot", *H, "n"]

    def build(rows: dict) -> Iterator[pa.RecordBatch]:
        cold = ~rows["hot"]
        for depth, path, total in subtree([rows[c][cold] for c in H], rows["n"][cold]) if cold.any() else ():
            keep = total >= min_count
            keep &= path[3] != 0 if depth == DEPTH else True             # a suffix of three words is no leaf of four
            h4 = path[3][keep] if depth == DEPTH else np.zeros(int(keep.sum()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h4), bool)), *(pa.array(c[keep]) for c in path[:3]), pa.array(h4), pa.array(total[keep])], names=names[1:])
        if not cold.all():
            _, path, total = next(subtree([rows[c][~cold] for c in H], rows["n"][~cold]))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(total), bool)), *map(pa.array, path), pa.array(total)], names=names[1:])

    def run(batches):
        held: list[dict] = []
        size = 0

        def joined() -> dict:
            return {c: np.concatenate([x[c] for x in held]) for c in names}

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in names})
            size += batch.num_rows
            if size >= MEMORY:
                rows = joined()
                cut = int(np.searchsorted(rows["group"], rows["group"][-1]))           # the last group may go on
                if cut:
                    yield from build({c: v[:cut] for c, v in rows.items()})
                rest = {c: v[cut:] for c, v in rows.items()}
                (_, path, total) = next(subtree([rest[c] for c in H], rest["n"]))      # a leaf that many chunks hold shrinks to one row
                held = [{"group": np.full(len(total), rest["group"][0]), "hot": np.full(len(total), rest["hot"][0]), "n": total} | dict(zip(H, path))]
                size = len(total)
        if held:
            yield from build(joined())

    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(run, "hot boolean, h1 long, h2 long, h3 long, h4 long, n long")


def _zeros(n: int) -> list[Column]:
    return [F.lit(0).cast("long")] * n


def _piece(first: int, last: int, names: list[str]) -> list[Column]:
    """The words first to last (from 1) of h1 to h4 as a phrase of its own."""
    words = [F.col(h) for h in H[first - 1:last]]
    return [c.alias(n) for c, n in zip([*words, *_zeros(DEPTH - len(words))], names)]


def frequent_phrases(texts: DataFrame, min_count: int, split: int) -> tuple[DataFrame, DataFrame]:
    """(the dictionary; d, h1 to h4, a: all phrases of one to four words that occur ``min_count`` times)."""
    sc = texts.sparkSession.sparkContext
    seed = 0
    while True:
        words = stage(dictionary(texts, seed), "words")
        if not words.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).collect():
            break
        drop(words)
        seed += 1
    common = words.where(F.col("n") >= min_count)
    frequent = sc.broadcast(Bitmap(common, "h"))
    pairs = stage(prefixes(texts, frequent, seed).where(F.col("n") >= min_count), "prefixes")

    def pair_hashes(batches):
        for b in batches:
            h1, h2 = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([_signed(together(h1, h2)), b.column(2)], names=["h", "n"])

    hashed = pairs.select("h1", "h2", "n").mapInArrow(pair_hashes, "h long, n long")
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = hashed.where(F.col("n") > max(split, total >> 20)).select("h").toArrow()["h"].to_numpy()      # 2^20 rows at most
    known, extended = sc.broadcast(Bitmap(hashed, "h")), sc.broadcast(np.sort(hot.view(np.uint64)))
    nodes = stage(subtrees(suffixes(texts, known, extended, seed), min_count), "nodes")
    above = nodes.where("hot").groupBy("h1", "h2", "h3").agg(F.sum("n").alias("n")).select("h1", "h2", "h3", *_zeros(1), "n")
    deep = nodes.where("NOT hot OR h4 <> 0").drop("hot").union(above)
    phrases = (common.select(F.lit(1), "h", *_zeros(3), "n").union(pairs.select(F.lit(2), "h1", "h2", *_zeros(2), "n"))
               .union(deep.select(F.when(F.col("h4") == 0, 3).otherwise(4), *H, "n"))).toDF("d", *H, "a").where(F.col("a") >= min_count)
    out = stage(phrases, "phrases")
    for t in (pairs, nodes):
        drop(t)
    frequent.destroy(), known.destroy(), extended.destroy()
    return words, out


def collocations(docs: DataFrame, top: int = 2000, min_count: int = 30, cover: int = 80, split: int = 1 << 14) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``docs`` needs lang (null: ``und``) and text (null: empty); every row is a document,
    copies too.  A phrase has two to four words of one piece and occurs
    ``a >= min_count`` times.  Of its cuts the lowest score
    floor(2000000 a / (l + r)) counts, ties to the first cut.  A phrase goes
    if a longer frequent one that holds its words occurs at least ``cover``
    percent as often.  Order: score, a (both descending), phrase by its UTF-8
    bytes.  A text of any length is read whole; other columns are ignored; an empty
    table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words, phrases = frequent_phrases(texts, min_count, split)
    several = phrases.where("d > 1")
    left, right = [f"l{i}" for i in range(1, 5)], [f"r{i}" for i in range(1, 5)]

    cuts = None
    for d in range(2, DEPTH + 1):
        for k in range(1, d):
            one = several.where(F.col("d") == d).select("d", *H, "a", F.lit(k).alias("k"), *_piece(1, k, left), *_piece(k + 1, d, right))
            cuts = one if cuts is None else cuts.union(one)
    parts_l = phrases.select(*[F.col(h).alias(c) for h, c in zip(H, left)], F.col("a").alias("l"))
    parts_r = phrases.select(*[F.col(h).alias(c) for h, c in zip(H, right)], F.col("a").alias("r"))
    wide = cuts.join(parts_l, left).join(parts_r, right)
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = wide.groupBy("d", *H, "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    inner = None
    for d in range(3, DEPTH + 1):
        for size in range(2, d):
            for first in range(1, d - size + 2):
                one = several.where(F.col("d") == d).select(*_piece(first, first + size - 1, H), F.col("a").alias("longer"))
                inner = one if inner is None else inner.union(one)
    over = inner.groupBy(*H).agg(F.max("longer").alias("longer"))
    by_100, by_cover = F.col("longer").cast("decimal(19,0)") * 100, F.col("a").cast("decimal(19,0)") * cover
    kept = best.join(over, H, "left").where(F.col("longer").isNull() | (by_100 < by_cover))

    named = words.where(F.col("n") >= min_count).select("h", "lang", "word")
    ranked = kept.join(named.withColumnRenamed("h", "h1").withColumnRenamed("word", "w1"), "h1")
    in_lang = "PARTITION BY lang ORDER BY best.score DESC, a DESC"
    ranked = ranked.withColumn("place", F.expr(f"rank() OVER ({in_lang})")).where(F.col("place") <= top)
    for i in range(2, DEPTH + 1):
        ranked = ranked.join(named.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}")), f"h{i}", "left")
    ranked = ranked.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(1, DEPTH + 1)]))
    ranked = ranked.withColumn("rank", F.expr(f"row_number() OVER ({in_lang}, phrase)").cast("long")).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
                                             F.col("best.score").cast("long").alias("score"))


#: The same with the default parameters over the view ``documents``, for DuckDB.
ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, w[i:i + d - 1] AS g FROM (
    SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM lists, (VALUES (1), (2), (3), (4)) AS t(d) WHERE len(w) >= d)
), total AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM lists GROUP BY lang
), f AS (
  SELECT lang, g, len(g) AS d, count(*)::HUGEINT AS a FROM grams GROUP BY lang, g HAVING count(*) >= 30
), cuts AS (
  SELECT lang, g, d, a, unnest(range(1, d)) AS k FROM f WHERE d > 1
), scored AS (
  SELECT c.lang, c.g, c.a, c.k, l.a AS l, r.a AS r, (2000000 * c.a) // (l.a + r.a) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.k + 1:c.d]
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
  SELECT lang, g[i:i + s - 1] AS g, a FROM (
    SELECT lang, g, a, s, unnest(range(1, d - s + 2)) AS i FROM f, (VALUES (2), (3)) AS t(s) WHERE d > s)
), over_ AS (
  SELECT lang, g, max(a) AS longer FROM inside GROUP BY lang, g
), ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM best LEFT JOIN over_ USING (lang, g) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

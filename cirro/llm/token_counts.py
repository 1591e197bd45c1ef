"""Token counts by unigram segmentation, shared over a trie of pre-tokens.

A pre-token is a run of characters without ASCII white space, with the word mark in
front.  Its tokens are the pieces of its best segmentation: the largest sum
of piece scores, and of equal sums the fewest tokens.  Characters that no
piece covers are written as bytes, one token each.

The vocabulary file holds merge ranks, not probabilities, so a piece's score
is taken from Zipf's law: minus the logarithm of its rank, as an integer
in millionths, which makes sums and ties exact.

In each chunk of text the distinct pre-tokens are sorted, which walks their
trie depth first: the forward scores of a prefix are worked out once and
stay on the stack while words below it follow.  Counts of words are kept
from chunk to chunk in a table of bounded size, and documents add them up.
No row is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.textops import CLASS, Rolling, runs, text_chunks

MARK = "▁"
CHUNK = 4 << 20
KEPT = 1 << 20
_VOCABULARIES: dict[str, tuple[dict[str, int | None], int]] = {}
_COUNTS: dict[str, dict[int, int]] = {}


def zipf(rank: int) -> int:
    return -round(1e6 * math.log(rank + 2))


def vocabulary(path: str) -> tuple[dict[str, int | None], int]:
    """(score of each piece and None for each beginning of one that is no piece; score of a byte)."""
    if path not in _VOCABULARIES:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[str, int | None] = {}
        rank = 0
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                piece = sp.id_to_piece(i)
                for n in range(1, len(piece)):
                    pieces.setdefault(piece[:n])
                pieces[piece] = zipf(rank)
                rank += 1
        _VOCABULARIES[path] = pieces, 2 * zipf(rank)
    return _VOCABULARIES[path]


def trie_counts(sorted_words: list[str], pieces: dict[str, int | None], byte_score: int) -> list[int]:
    """Tokens of each word of a sorted list; prefixes that neighbours share are scored once.

    The stacks hold, for each prefix of the current word, its best score, the
    tokens of that, and the places from which a piece may still go on.
    """
    out, before = [], ""
    score, tokens, going = [0], [0], [()]
    for word in sorted_words:
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del score[shared + 1:], tokens[shared + 1:], going[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            width = len(word[end - 1].encode())
            best, fewest = score[end - 1] + width * byte_score, tokens[end - 1] + width
            on = []
            for start in (*going[end - 1], end - 1):
                s = pieces.get(word[start:end], 0)
                if s is None:
                    on.append(start)
                elif s:
                    on.append(start)
                    s += score[start]
                    if s > best or s == best and tokens[start] + 1 < fewest:
                        best, fewest = s, tokens[start] + 1
            score.append(best)
            tokens.append(fewest)
            going.append(on)
        before = word
        out.append(tokens[len(word)])
    return out


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens, n_distinct.

    ``docs`` needs doc_id and text; null and empty texts have no tokens; a
    null doc_id stays null; rows that repeat a doc_id are counted one by one;
    other columns are ignored; an empty table gives no rows.
    """
    def run(batches):
        pieces, byte_score = vocabulary(model_file)
        known = _COUNTS.setdefault(model_file, {})
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1), CHUNK):
                start, end, row = runs(CLASS[data] > 0, offsets)
                rows = b - a
                key, first, which = np.unique(Rolling(data).of(start, end), return_index=True, return_inverse=True)
                keys = key.tolist()
                count = np.array([known.get(k, -1) for k in keys], dtype=np.int64)
                new = np.flatnonzero(count < 0)
                if len(new):
                    raw = data.tobytes()
                    text = [MARK + raw[x:y].decode() for x, y in zip(start[first[new]].tolist(), end[first[new]].tolist())]
                    order = sorted(range(len(text)), key=text.__getitem__)
                    count[new[order]] = trie_counts([text[i] for i in order], pieces, byte_score)
                    if len(known) + len(new) > KEPT:
                        known.clear()
                    known.update(zip((keys[i] for i in new.tolist()), count[new].tolist()))
                words = np.bincount(row, minlength=rows)
                total = np.bincount(row, weights=count[which], minlength=rows).astype(np.int64)
                pairs = np.unique(row * len(key) + which) // max(len(key), 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, rows), pa.array(words.astype(np.int64)), pa.array(total),
                     pa.array(np.bincount(pairs, minlength=rows).astype(np.int64))],
                    names=["doc_id", "n_pretokens", "n_tokens", "n_distinct"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_pretokens long, n_tokens long, n_distinct long")

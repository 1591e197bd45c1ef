"""Token alignment against a version in plain Python, and on odd rows."""

import hashlib
import random
from collections import Counter

import public_tokenizers as p
import pytest

from cirro.llm import token_alignment as ta

FILES = p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, pairs int, chunk long"


def plain(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each row, by comparing token ranges."""
    import sentencepiece
    from tokenizers import Tokenizer
    a_tok = Tokenizer.from_file(FILES[0])
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = {}
    n = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters[chr(b)] = b
        else:
            letters[chr(256 + n)] = b
            n += 1

    def ranges(tokens):
        at, out = 0, []
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    def b_raw(i):
        piece = b_tok.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_tok.is_byte(i) else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        enc = a_tok.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
        b = [(i, b_raw(i)) for i in b_tok.encode(text)]
        want = (" " + text).encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            found.append((doc_id, [], [], [], 0))
            continue
        a, b = ranges(a), ranges(b)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        text_, lo = [], 0
        for e in cuts:
            text_.append(",".join(str(i) for i, s, t in a if lo < t <= e) + "|" + ",".join(str(i) for i, s, t in b if lo < t <= e))
            lo = e
        links = [(i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e]
        counts.update(links)
        found.append((doc_id, a, b, links, text_))
    most = Counter()
    for (_, j), c in counts.items():
        most[j] = max(most[j], c)
    return Counter((d, len(a), len(b), len(t) if t else 0, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(";".join(t).encode()).hexdigest() if t else "") for d, a, b, links, t in found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["naïve", "don't", "Straße", "x=1", "  two", "漢字", "🙂", "\t", "the", "of", "<|endoftext|>", "</s>", "un­seen", "a\nb", "ﬁ", " ", "IX", "<0x41>"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    texts += [None, "", " ", "  ", "ends ", " starts", "mark ▁ inside", "nul \x00 byte", "same text", "same text", "a" * 3000, "́combining"]
    return [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, "other text of three"), (3, "other text of three")]


def test_alignment_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    for size in (4 << 20, 300):
        got = ta.align_tokenizers(docs, *FILES, chunk_bytes=size).collect()
        assert Counter(map(tuple, got)) == plain(rows)
    assert ta.align_tokenizers(docs.limit(0), *FILES).count() == 0
    assert ta.align_tokenizers(docs, *FILES).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_long_text_in_slices(spark, monkeypatch, rows):
    """Slices give the same tokens, groups and links as the whole text."""
    pair = ta.tokenizers(*FILES)
    text = " ".join(t for _, t in rows if t and "▁" not in t) * 3
    whole = ta.Alignment(pair, ta.one(text))
    monkeypatch.setattr(ta, "SLICE", 200)
    parts = pair.slices(text)
    assert len(parts) > 5 and " ".join(parts) == text
    numbers, digest, links = ta._merged(ta.Alignment(pair, ta.one(x)) for x in parts)
    assert numbers == [int(x[0]) for x in (whole.n_a, whole.n_b, whole.n_groups, whole.n_links)]
    assert digest == hashlib.sha256(whole.strings[0]).hexdigest()
    assert sorted(map(tuple, (r.values() for r in links.to_pylist()))) == sorted(map(tuple, (r.values() for r in whole.links.to_pylist())))


def test_very_long_text(spark):
    text = "long words and short ones 12 " * 90_000
    got = ta.align_tokenizers(spark.createDataFrame([(1, text), (2, text + "▁")], "doc_id long, text string"), *FILES).collect()
    a = {r["doc_id"]: r for r in got}
    assert a[2]["n_a"] == 0 and a[2]["groups_sha256"] == ""
    assert a[1]["n_a"] + a[1]["n_b"] - a[1]["n_groups"] == a[1]["n_links"] > 90_000


def test_units_together_and_alone():
    """Units encoded as long texts have the ids they have alone; what is known is kept up to a bound."""
    import numpy as np
    import pyarrow as pa

    from cirro.llm import byte_bpe
    rng = random.Random(3)
    pool = [" word", " é", " xé", " don't", " 12", " a ", " a\n", "  two", " ", "first", " <|endoftext|>", " a<|endoftext|>b", " …", " 漢", " ß.", " Straße,", "", " x" * 1]
    units = [rng.choice(pool) + "".join(rng.choice("abcé1. ") for _ in range(rng.randint(0, 4))) for _ in range(3000)]
    arr = pa.array([u.encode() for u in units], pa.large_binary())
    for as_text in (False, True):
        t = byte_bpe.UnitTokenizer(FILES[0], as_text)
        want = [t.whole.encode(u, add_special_tokens=False).ids for u in units]
        assert t.lists(arr).to_pylist() == want
        known = byte_bpe.Known(lambda u: (u, t.lists(u)), 500)
        for a in range(0, 3000, 300):
            part = pa.array(sorted({u.encode() for u in units[a:a + 300]}), pa.large_binary())
            (lists,), at = known.find(part)
            assert lists.take(pa.array(at)).to_pylist() == [t.whole.encode(u.decode(), add_special_tokens=False).ids for u in part.to_pylist()]
            assert len(known.units) <= 500
    assert np.array(want, dtype=object).shape == (3000,)

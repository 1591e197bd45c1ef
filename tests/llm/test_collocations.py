"""Collocations against a version in plain Python, and on odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from cirro.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, rank string, phrase int, a long"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=2000, least=30, cover=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UP)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for d in range(1, 5):
                for i in range(len(w) - d + 1):
                    f[lang, tuple(w[i:i + d])] += 1
    longer = Counter()
    for (lang, p), a in f.items():
        if a >= least:
            for s in range(2, len(p)):
                for i in range(len(p) - s + 1):
                    q = (lang, p[i:i + s])
                    longer[q] = max(longer[q], a)
    out = []
    by_lang = {}
    for (lang, p), a in f.items():
        if a < least or len(p) < 2 or longer[lang, p] and 100 * longer[lang, p] >= cover * a:
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["New", "york", "of", "the", "ÉTÉ", "été", "to", "be", "or", "not", "x-y", "漢字", "it's", "<a>"]
    rare = [f"w{i}" for i in range(400)]

    def text():
        out = []
        for _ in range(rng.randint(1, 60)):
            x = rng.random()
            out.append("to be or not" if x < 0.1 else "New York" if x < 0.2 else rng.choice(rare) if x < 0.4 else rng.choice(words))
            out.append(rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", " ", "\x0b"]))
        return "".join(out)
    found = [(text(), rng.choice(["en", "en", "de", None, "und"])) for _ in range(150)]
    found += [(None, "en"), ("", "en"), (" \t", None), ("...", "fr"), ("a b c d " * 40, "fr"), ("same words here. " * 31, "es")] + [("copy of one text", "it")] * 40
    return found


def frame(spark, rows):
    return spark.createDataFrame([(i % 5 or None, t, lang, "r", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("options", [{}, {"top": 7}, {"split": 5}, {"min_count": 3, "cover": 50, "split": 20}])
def test_brute_force(spark, rows, options, monkeypatch):
    got = Counter(map(tuple, co.collocations(frame(spark, rows), **options).collect()))
    want = plain(rows, options.get("top", 2000), options.get("min_count", 30), options.get("cover", 80))
    assert sum(want.values()) > 5 and got == want


def test_small_groups_and_chunks(spark, rows, monkeypatch):
    """The same counts whatever the memory of a task and the size of a part of text."""
    monkeypatch.setattr(co, "MEMORY", 7)
    monkeypatch.setattr(co, "CHUNK", 50)

    def batches(columns, step):
        import pyarrow as pa
        order = np.argsort(columns["group"], kind="stable")
        for i in range(0, len(order), step):
            yield pa.RecordBatch.from_arrays([pa.array(columns[c][order[i:i + step]]) for c in columns], names=list(columns))

    rng = np.random.default_rng(1)
    n = 400
    h = rng.integers(1, 4, (4, n))
    h[3][rng.random(n) < 0.3] = 0
    hot = h[0] == 3
    columns = {"group": np.where(hot, 1000 + h[0] * 64 + h[1] * 16 + h[2] * 4 + h[3], h[0] * 4 + h[1]), "hot": hot, **{f"h{i + 1}": h[i] for i in range(4)}, "n": rng.integers(1, 5, n)}

    class Dealt:                                                       # what Spark hands to one task
        def __getattr__(self, name):
            return (lambda run, _: run) if name == "mapInArrow" else lambda *a: self
    run = co.subtrees(Dealt(), 10)
    got = Counter()
    for b in run(batches(columns, 3)):
        for r in b.to_pylist():
            key = (r["hot"], r["h1"], r["h2"], r["h3"], r["h4"])
            assert key not in got
            got[key] = r["n"]
    three, four = Counter(), Counter()
    for i in range(n):
        key = tuple(int(h[j][i]) for j in range(4))
        four[(bool(hot[i]), *key)] += int(columns["n"][i])
        three[(bool(hot[i]), *key[:3], 0)] += int(columns["n"][i])
    want = {k: v for k, v in four.items() if k[0] or v >= 10 and k[4]} | {k: v for k, v in three.items() if not k[0] and v >= 10}
    assert got == want


def test_long_text_in_parts():
    rng = random.Random(8)
    data = np.frombuffer("".join(rng.choice("ab  ,é漢") for _ in range(3000)).encode(), np.uint8)
    zero = np.zeros(1, np.uint64)
    whole = co.Words(data, np.array([0, len(data)]), zero, len(data), 0)
    want = Counter(tuple(whole.hash[i:i + 4]) for i in range(len(whole.hash)) if whole.goes_on[i:i + 3].all())
    got, n = Counter(), 0
    for own, part, offsets in co.parts(data, np.array([0, len(data)]), 40):
        w = co.Words(part, offsets, zero, own, 0)
        n += int(w.own.sum())
        got.update(tuple(w.hash[i:i + 4]) for i in np.flatnonzero(w.own) if i + 4 <= len(w.hash) and w.goes_on[i:i + 3].all() or i + 4 > len(w.hash) and w.goes_on[i:].all())
    tail = Counter(tuple(whole.hash[i:i + 4]) for i in range(len(whole.hash) - 3, len(whole.hash)) if whole.goes_on[i:].all())
    assert n == len(whole.hash)
    assert got - tail == want - tail


def test_bitmap_lets_all_members_pass(spark):
    rng = np.random.default_rng(0)
    h = rng.integers(-2**63, 2**63, 5000)
    bits = co.Bitmap(spark.createDataFrame([(int(x),) for x in h], "h long"), "h")
    assert bits.holds(h.view(np.uint64)).all()
    assert bits.holds(rng.integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.2


def test_empty_table(spark):
    got = co.collocations(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_exact_beyond_64_bits(spark):
    big = 5 * 10**15
    row = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long").selectExpr(
        "(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) AS s").first()
    assert row["s"] == 2000000 * big // (2 * big + 3)

"""Work that must not grow with the square of what a text holds, and results on such texts."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cirro.llm import decontamination, embedding_dedup, license_scan, packing, secret_scan
from cirro.llm.queries import vocabulary_files
from test_operators_helpers import base_spans


def masked(text, spans, mark="[SECRET]"):
    """Spans that overlap give one mark."""
    out, at = "", 0
    for s, e in sorted(spans):
        if s >= at:
            out += text[at:s] + mark
        at = max(at, e)
    return out + text[at:]


def test_many_secrets_in_one_text(spark):
    """16,000 matches in 250 KB; positions and masks as in plain Python."""
    rng = random.Random(1)
    parts = []
    for i in range(16000):
        parts.append(rng.choice(["token=abcdefgh", "é AKIA" + "A1" * 6, "password: AKIA" + "B2" * 7 + "x", "漢 words"]))
    text = " ".join(parts)
    docs = spark.createDataFrame([(1, text), (2, "secret=" + "a" * 40 + "0123456789abcdef" * 4), (3, None), (4, "x" * 9000 + " token=abcdefgh " + "y" * 9000)], "doc_id long, text string")
    began = time.time()
    out = {r["row"]["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    red = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    took = time.time() - began
    for i, t in ((1, text), (2, docs.collect()[1]["text"]), (4, docs.collect()[3]["text"])):
        assert [(s["start"], s["kind"], s["end"]) for s in out[i]["base"]] == base_spans(t)
        assert red[i] == masked(t, [(s["start"], s["end"]) for s in out[i]["found"]])
    assert red[3] is None and took < 60


def test_many_notices_in_one_text():
    book = license_scan.Templates(license_scan.TEMPLATES)
    line = "Released under the MIT License. some words here and there\n"
    times = []
    for n in (2000, 8000):
        data = np.frombuffer((line * n).lower().encode(), np.uint8)
        began = time.time()
        found = book.find(data, np.array([0, len(data)]), 0.8, 1.5)
        times.append(time.time() - began)
        assert len(found) == n
    assert times[1] < 10 * times[0] + 0.5


def least_edits(pattern, text):
    """Fewest edits of the pattern against any stretch of the text."""
    row = np.zeros(len(text) + 1, dtype=int)
    t = np.array([ord(c) for c in text])
    for i, ch in enumerate(pattern):
        new = np.empty_like(row)
        new[0] = i + 1
        step = np.minimum(row[:-1] + (t != ord(ch)), row[1:] + 1)
        # left neighbours: running minimum of step[j] - j
        new[1:] = np.minimum.accumulate(np.concatenate(([new[0]], step - np.arange(1, len(t) + 1))))[1:] + np.arange(1, len(t) + 1)
        row = new
    return int(row.min())


def test_passages_against_an_independent_distance(spark):
    """Substitutions, insertions and deletions, every document against every item; short items; all places."""
    rng = random.Random(4)

    def prose(n):
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 8))) for _ in range(n))
    items = [(i, prose(rng.randint(6, 25))) for i in range(10)] + [(20, "qzx"), (21, "Wk"), (22, "")]
    docs = []
    for i in range(40):
        t = list(items[i % 10][1])
        for _ in range(rng.randint(0, 14)):
            k = rng.randrange(len(t))
            what = rng.random()
            if what < 0.4:
                t[k] = rng.choice("aeiou#")
            elif what < 0.7:
                t.insert(k, "#")
            else:
                del t[k]
        docs.append((i, prose(20) + (" qZx " if i % 9 == 0 else " ") + "".join(t) + " " + prose(8) + ("wk" if i % 11 == 0 else "")))
    D, B = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontamination.find_passages(D, B).collect():
        got.setdefault((r["doc_id"], r["item_id"]), []).append((r["edits"], r["start"], r["end"]))
    for d, text in docs:
        for i, item in items:
            if not item:
                continue
            low = text.lower()
            most = decontamination.allowed(len(item), 0.1) if len(item) >= decontamination.Q else 0
            edits = least_edits(item.lower(), low)
            assert ((d, i) in got) == (edits <= most), (d, i, edits, most)
            if (d, i) in got:
                assert min(got[d, i])[0] == edits
                for e, a, b in got[d, i]:
                    assert least_edits(item.lower(), low[a:b]) == e or b - a == len(item)
    kept = {r["doc_id"] for r in decontamination.clean(D, B).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_all_places_of_a_passage(spark):
    item = "the same passage of some words again"
    text = f"x {item} y {item.upper()} z {item.replace('words', 'wards')}"
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item), (6, "y")], "item_id long, text string")
    for block in (1 << 20, 10):
        got = sorted((r["item_id"], r["start"], r["end"], r["edits"]) for r in decontamination.find_passages(docs, bench, block_chars=block).collect())
        a = [m.start() for m in re.finditer("the same", text.lower())]
        assert [g for g in got if g[0] == 5] == [(5, a[0], a[0] + len(item), 0), (5, a[1], a[1] + len(item), 0), (5, a[2], a[2] + len(item), 1)]
        assert [g[1] for g in got if g[0] == 6] == [i for i, c in enumerate(text.lower()) if c == "y"]


def test_short_rows_and_many_passages_need_little_memory():
    """6,000 rows and as many passages in one chunk: counts of the pairs that occur only."""
    import tracemalloc
    rng = random.Random(2)
    items = [(i, "".join(rng.choice("abcdefgh") for _ in range(14))) for i in range(6000)]
    texts = [t for _, t in items]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.arange(0, 14 * 6000 + 1, 14)
    book = decontamination.Passages(items, 0.1)
    tracemalloc.start()
    got = book.matches(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(r, i) for r, i, *_ in got} >= {(i, i) for i in range(6000)} and peak < 60e6


def test_cells_follow_the_number_of_vectors():
    for n in (1000, 10**6, 10**9):
        spread, tables = embedding_dedup.cell_plan(n, 0.9, 64, 1e-3)
        assert n / (2 * spread) ** 2 <= 64 + 1e-9 or spread == 16
        p = embedding_dedup.shared_extreme(0.9, spread, 4000) ** 2
        assert (1 - p) ** tables < 5e-3


@pytest.mark.parametrize("spread", [16, 60])
def test_recall_with_more_cells(spark, spread):
    """Pairs near the threshold are found with the tables that the plan asks for."""
    rng = np.random.default_rng(spread)
    x = rng.normal(size=(300, 24))
    pairs = np.vstack([x, 0.92 * x / np.linalg.norm(x, axis=1, keepdims=True) + 0.39 * (lambda e: e / np.linalg.norm(e, axis=1, keepdims=True))(rng.normal(size=x.shape))])
    u = pairs / np.linalg.norm(pairs, axis=1, keepdims=True)
    want = np.triu(u @ u.T >= 0.9, 1)
    tables = embedding_dedup.cell_plan((2 * spread) ** 2 * 64, 0.9, 64, 1e-3)[1]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(pairs)], "vec_id long, embedding array<double>")
    got = sum(r["n_links"] for r in embedding_dedup.vector_links(df, spread=spread, tables=tables).collect()) / 2
    assert want.sum() > 100 and got >= 0.98 * want.sum()


def test_a_vector_that_many_rows_share(spark):
    rng = np.random.default_rng(0)
    same = [0.5, 0.1, -0.2, 0.9]
    rows = [(i, same) for i in range(400)] + [(1000 + i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(60, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.vector_links(df).collect()}
    assert got == {i: int(n) for (i, _), n in zip(rows, links)}


def test_unit_encoding_equals_whole_texts():
    enc = packing.encoder(vocabulary_files())
    rng = random.Random(5)
    pieces = ["word", " ", "  ", "\n", "é", "ß ", "\u00a0", " \u00a0", "\u3000 ", "'s", "12 ", "<|endoftext|>", "🙂 ", "…", "\t ", "x=1", ". "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    for t in texts:
        enc.check(t)
    ids, starts = enc.encode(pa.array(texts, pa.large_string()))
    for t, a, b in zip(texts, starts, starts[1:]):
        assert ids[a:b].tolist() == enc.slow.encode(t, add_special_tokens=False).ids
    assert Counter(np.diff(starts).tolist())

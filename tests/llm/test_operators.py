"""Each operator against a brute-force version, and on odd rows.

Odd rows: null and empty texts, null ids, rows that repeat, a very long
text, ties, further columns whose names clash with results, empty tables.
"""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirro.llm import decontamination, embedding_dedup, license_scan, minhash_dedup, packing, quality, secret_scan, suffix_dedup, token_counts, toxicity
from cirro.llm.graph import components
from cirro.llm.queries import QUERIES, table, vocabulary_files
from cirro.llm.textops import shingle_hashes
from test_operators_helpers import base_spans, grams

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, kept int, row string, n_chars long"


def _prose(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(7)
    base = _prose(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [(1, base), (2, base), (3, near), (4, None), (5, ""), (None, base), (None, None), (6, _prose(rng, 40000)), (6, "other words"),
             (7, "  \n "), (8, "one two"), (8, "one two"), (9, "ab" * 700), (10, base[:200] + " " + _prose(rng, 30)), (11, "émoi ûber " * 90)]
    texts += [(i, _prose(rng, rng.randint(1, 300))) for i in range(20, 60)]
    return spark.createDataFrame([(i, t, "x", 1, "r", len(t or "")) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {}
    for a, b in edges:
        if a is not None and a != b:
            low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(500):
        for a, b in edges:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low


def test_packing_holds_every_id_once(spark, odd, empty):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(vocabulary_files()[0])
    special = spark.createDataFrame([(90, "a <|endoftext|> b", "x", 1, "r", 1)], SCHEMA)
    docs = odd.union(special)
    for capacity in (16, 2048):
        got = packing.pack(docs, vocabulary_files(), capacity=capacity).toPandas()
        want = Counter()
        for r in docs.collect():
            ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            want[r["doc_id"], len(ids)] += len(ids)
            if r["doc_id"] is not None and r["doc_id"] >= 20:
                mine = got[got.doc_id == r["doc_id"]].sort_values("start")
                for p in mine.itertuples():
                    assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
        have = Counter()
        for p in got.itertuples():
            have[None if np.isnan(p.doc_id) else int(p.doc_id), p.doc_tokens] += p.length
        assert have == want
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= capacity
        assert packing.padding(got, capacity) < capacity
    assert packing.pack(empty, vocabulary_files()).count() == 0


def test_fast_encoder_agrees():
    enc = packing.encoder(vocabulary_files())
    rng = random.Random(3)
    for _ in range(200):
        enc.check("".join(rng.choice("ab 'é1\n\t<|>ßЖ漢  .") for _ in range(60)))


def test_suffix_dedup_brute_force(spark, odd, empty):
    def expect(rows, length):
        data = [(t or "").encode() for _, t in rows]
        seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
        out = []
        for (doc_id, _), d in zip(rows, data):
            mark = np.zeros(len(d) + 1, int)
            for i in range(len(d) - length + 1):
                if seen[d[i:i + length]] > 1:
                    mark[i] += 1
                    mark[i + length] -= 1
            on = np.cumsum(mark)[:-1] > 0
            kept = bytes(np.frombuffer(d, np.uint8)[~on])
            out.append((doc_id, len(d), int(on.sum()), int((np.diff(np.concatenate(([0], on.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        return Counter(out)

    for length, gap in ((400, 320), (90, 40)):
        rows = [(r["doc_id"], r["text"]) for r in odd.collect() if len(r["text"] or "") < 20000]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = suffix_dedup.remove_repeats(docs, length, gap).drop("removed", "kept").collect()
        assert Counter(map(tuple, got)) == expect(rows, length)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_near_duplicates_brute_force(spark, odd, empty):
    rng = random.Random(11)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for family in range(6):
        words = _prose(rng, 150).split()
        for i in range(25):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                copy[rng.randrange(len(copy))] = _prose(rng, 1)
            rows.append((1000 + family * 100 + i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = sorted({i for i, t in rows if i is not None})
    sets = [(i, grams(t)) for i, t in rows if i is not None]
    low = {i: i for i in ids}
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x and y and len(x & y) >= 0.8 * len(x | y)]
    for _ in range(60):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = minhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == low
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["class_id"]) for r in got)
    assert minhash_dedup.near_duplicates(empty).count() == 0
    kept = minhash_dedup.keep_one(odd).collect()
    assert kept and set(kept[0].asDict()) == set(odd.columns)
    count = Counter(r["doc_id"] for r in kept)
    assert count[1] == 1 and 2 not in count and 3 not in count and count[8] == 1 and count[None] == 2 and count[4] == count[5] == 1


def test_near_duplicates_sharing_few_sketch_values(spark):
    # ``a`` and ``b`` match 4 of 5 grams but share one or two values; a text with three of the grams is the hub of those buckets.
    def values(texts):
        data = "".join(texts).encode()
        h, at = shingle_hashes(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]), 5)
        return minhash_dedup.order_minhash(h, at, 24, 3)

    long = [[f"w{i}x{j}" for j in range(9)] for i in range(80000)]
    a, b, hub = values([" ".join(w[:8]) for w in long]), values([" ".join(w) for w in long]), values([" ".join(w[:7]) for w in long])
    few = np.flatnonzero(((a == b) == (b == hub)).all(1) & ((a == b).sum(1) > 0) & ((a == b).sum(1) < 3))
    assert len(few)
    rows = []
    for at, i in enumerate(few[:5].tolist()):
        w, low = long[i], at * 100
        rows += [(low, " ".join(w[:8])), (low + 1, " ".join(w)), (low + 2, " ".join(w[:7]))]
        rows += [(low + 10 + j, " ".join([f"front{j}", *w[:7]])) for j in range(30)]
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 1 if i % 100 == 1 else i for i, _ in rows}


def test_near_duplicates_of_clashing_ids(spark):
    rng = random.Random(12)
    a, b, c, d = (_prose(rng, 80).split() for _ in range(4))
    near = {name: " ".join(w[:40] + ["changed"] + w[41:]) for name, w in (("a", a), ("b", b), ("c", c))}
    a, b, c, d = map(" ".join, (a, b, c, d))
    # 7: two unlike texts, either with a near duplicate elsewhere; 3: its own near duplicate and an unlike text.
    rows = [(7, a), (7, b), (8, near["a"]), (5, near["b"]), (3, c), (3, near["c"]), (3, d), (9, None), (9, d + " x"), (-4, "no words like it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {(7, a): 7, (8, near["a"]): 7, (7, b): 5, (5, near["b"]): 5, (3, c): 3, (3, near["c"]): 3, (3, d): 3, (9, d + " x"): 3, (-4, rows[-1][1]): -4}
    got = {(r["doc_id"], r["t"]): r for r in minhash_dedup.text_classes(docs).collect()}
    t = {r["text"]: r["t"] for r in docs.withColumn("t", F.xxhash64("text")).collect()}
    assert {k: got[k[0], t[k[1]]]["class_id"] for k in want} == want and len(got) == len(want)
    assert got[3, t[c]]["class"] == got[3, t[near["c"]]]["class"] != got[3, t[d]]["class"]
    out = minhash_dedup.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["kept"], r["class_size"]) for r in out) == Counter(
        [(7, 7, True, 2), (7, 5, False, 2), (8, 7, False, 2), (5, 5, True, 2), (3, 3, True, 2), (3, 3, True, 2), (3, 3, True, 2), (9, 9, True, 1),
         (9, 3, False, 2), (-4, -4, True, 1)])
    kept = Counter((r["doc_id"], r["text"]) for r in minhash_dedup.keep_one(docs).collect())
    one = [x for x in ((3, c), (3, near["c"])) if kept.pop(x, 0)]
    assert len(one) == 1 and kept == Counter([(7, a), (5, near["b"]), (3, d), (9, None), (-4, rows[-1][1])])


def test_alignment_is_ordered():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = rng.integers(0, 6 if _ % 2 else 500, 80).astype(np.uint64)
        b = np.delete(a, rng.integers(0, 80, rng.integers(0, 9)))
        b = np.insert(b, rng.integers(0, len(b), 4), 777)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        s = t[-1, -1] / (len(a) + len(b) - t[-1, -1])
        assert minhash_dedup.aligned(a, b, 0.8) == pytest.approx(s if s >= 0.8 else 0.0)


def test_embedding_links_brute_force(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((60, 32))
    x = np.concatenate([centre, *(centre[:30] + rng.normal(0, s, (30, 32)) for s in (0.1, 0.3, 0.45))]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(500, x[0].tolist(), 0), (501, (x[1] * 3).tolist(), 0), (502, None, 0), (503, [0.0] * 32, 0),
            (504, [float("nan")] * 32, 0), (505, [None, 1.0], 0), (506, [], 0), (None, x[0].tolist(), 0), (507, [float("inf")] + [1.0] * 31, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept int")
    got = {r["vec_id"]: r for r in embedding_dedup.vector_links(df, block=32).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    u = np.array([v / np.linalg.norm(v) for _, v in good])
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i]["n_links"] for i, _ in good)
    assert all(got[i]["n_links"] <= n for (i, _), n in zip(good, near.sum(1)))
    assert found >= 0.99 * near.sum() > 0
    for i in (502, 503, 504, 505, 506, 507, None):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert got[500]["component_id"] == 0 and not got[500]["kept"]
    assert embedding_dedup.vector_links(df.limit(0)).count() == 0


def test_token_counts_brute_force(spark, odd, empty):
    import public_tokenizers as p
    path = p.path("piece_bpe_32k.model")
    pieces, byte_score = token_counts.vocabulary(path)

    def best(word):
        at = [(0, 0)]
        for end in range(1, len(word) + 1):
            width = len(word[end - 1].encode())
            options = [(at[end - 1][0] + width * byte_score, -(at[end - 1][1] + width))]
            for start in range(end):
                s = pieces.get(word[start:end])
                if s is not None:
                    options.append((at[start][0] + s, -(at[start][1] + 1)))
            score, tokens = max(options)
            at.append((score, -tokens))
        return at[-1][1]

    docs = odd.where("length(text) < 5000 OR text IS NULL")
    got = Counter((r["doc_id"], r["n_pretokens"], r["n_tokens"], r["n_distinct"]) for r in token_counts.count_tokens(docs, path).collect())
    want = Counter()
    for r in docs.collect():
        words = re.findall(r"[^\t\n\x0b\x0c\r ]+", r["text"] or "")
        want[r["doc_id"], len(words), sum(best(token_counts.MARK + w) for w in words), len(set(words))] += 1
    assert got == want
    assert token_counts.count_tokens(empty, path).count() == 0


def test_license_scan(spark, odd, empty):
    rng = random.Random(5)
    mit = license_scan.TEMPLATES["MIT"].split()
    changed = [w for i, w in enumerate(mit) if i % 12]
    docs = spark.createDataFrame([
        (1, _prose(rng, 300) + "\nReleased under the MIT License.\n" + _prose(rng, 50)), (2, " ".join(changed)),
        (3, "the software is the license of the work"), (4, "Licensed under CC BY-NC 4.0. " + _prose(rng, 9) + " All rights reserved."),
    ], "doc_id long, text string")
    got = license_scan.scan_licenses(docs).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(1, "MIT notice"), (2, "MIT"), (4, "CC-BY-NC-4.0 notice"), (4, "Reserved notice")}
    assert next(r for r in got if r["doc_id"] == 2)["n_matched"] == len(re.findall(r"\w+", " ".join(changed)))
    assert license_scan.scan_licenses(odd).count() == 0 and license_scan.scan_licenses(empty).count() == 0


def test_license_scan_tells_licenses_apart(spark, odd):
    rng = random.Random(15)
    full = license_scan.TEMPLATES
    cases = [
        ("Released under the BSD License", {"BSD notice"}), ("Licensed under CC BY 3.0", {"CC-BY-3.0 notice"}), ("Released under the Foo License", set()),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1", {"LGPL-2.1 notice"}),
        ("This work is licensed under the GNU Affero General Public License, version 3", {"AGPL-3.0 notice"}),
        ("This work is licensed under the GNU General Public License, version 2", {"GPL-2.0 notice"}),
        ("Licensed under the Mozilla Public License, Version 2.0", {"MPL-2.0 notice"}), ("Licensed under the Apache License, Version 1.1", set()),
        ("Licensed under CC BY-NC-ND 4.0", {"CC-BY-NC-ND-4.0 notice"}), ("Licensed under CC0 1.0", {"CC0-1.0 notice"}), ("All the rights reserved", set()),
        ("Distributed under the MIT License", {"MIT notice"}), ("Licensed under the Eclipse Public License, Version 2.0", {"EPL-2.0 notice"}),
        *((full[n], {n}) for n in ("BSD-2-Clause", "BSD-3-Clause", "LGPL", "AGPL", "GPL", "Unlicense")),
    ]
    docs = spark.createDataFrame([(i, _prose(rng, 30) + "\n" + t + ".\n" + _prose(rng, 30)) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {i: set() for i in range(len(cases))}
    for r in license_scan.scan_licenses(docs).collect():
        got[r["doc_id"]].add(r["license"])
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_longest_increasing():
    rng = random.Random(9)
    for _ in range(50):
        v = rng.sample(range(30), 12)
        best = [1] * 12
        for i in range(12):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        places = license_scan.longest_increasing(v)
        assert len(places) == max(best) and [v[i] for i in places] == sorted(v[i] for i in places) and places == sorted(places)


def test_secret_scan(spark, odd, empty):
    rng = random.Random(6)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["é password = 'abcDEF123456' x", "Token:short1 secret=secret: abcdefghij", "AKIA" + "A1" * 8 + " AKIA12", "0123456789abcdef" * 3 + "g" + "ab" * 20,
             "API_KEY=0123456789abcdef0123456789abcdef0123", "", None, "token=secret: abcdefghij"]
    texts += ["".join(rng.choice("tokensecrtpawdAKI =:'0123456789abcdef") for _ in range(400)) for _ in range(60)]
    planted = ["".join(rng.choice(chars) for _ in range(40)) for _ in range(30)]
    plain = ["word1" * 8, "version-1-of-the-thing-2-and-more", "aaaaaaaaaaaaaaaaaaaa1", "abababababababababab12", "000000000000000000000000"]
    texts += ["see " + s + " here" for s in planted + plain * 6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = secret_scan.scan(docs).collect()
    for r in out:
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == base_spans(texts[r["row"]["doc_id"]] or "")
    random_ids = {r["row"]["doc_id"] for r in out if any(s["start"] == 4 for s in r["random"])}
    first = len(texts) - 30 - len(planted)
    assert len(random_ids & set(range(first, first + 30))) >= 25
    assert not random_ids & set(range(first + 30, len(texts)))
    red = {r["doc_id"]: r for r in secret_scan.redact(docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("found", F.lit(1))).collect()}
    assert red[0]["text"] == "é [SECRET]' x" and red[0]["n_chars"] == len(red[0]["text"]) and red[6]["text"] is None and red[0]["found"] == 1
    assert secret_scan.digest(secret_scan.scan(odd)).count() == odd.count() and secret_scan.redact(empty).count() == 0


def test_secret_scan_padded_and_glued(spark):
    rng = random.Random(16)
    plain = ["word1" * 8, "version-1-of-the-thing-2-and-more", "aaaaaaaaaaaaaaaaaaaa1", "abababababababababab12", "LONG_NAME_OF_1_SETTING=no", "a1====" * 9]
    cases = []
    for _ in range(12):
        for left, n, right in (("Authorization: Basic ", 28, "\n"), ("DefaultEndpoints;AccountKey=", 64, ";Suffix=x"), ("k = ", 40, "")):
            cases.append((left, base64.b64encode(rng.randbytes(n)).decode(), right))
        for left, right in (("SIGNING_KEY=", " x"), ("https://h.example/p?sig=", "&v=2"), ("LONG_NAME_OF_1_SETTING=", "")):
            cases.append((left, "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)), right))
        cases.append(("mfa: ", base64.b32encode(rng.randbytes(31)).decode(), "."))
    texts = [a + s + b for a, s, b in cases] + ["see " + t + " here" for t in plain * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["row"]["doc_id"]: [(s["start"], s["end"]) for s in r["random"]] for r in secret_scan.scan(docs).collect()}
    want = {i: [(len(a), len(a) + len(s))] for i, (a, s, _) in enumerate(cases)}
    assert any(s.endswith("==") for _, s, _ in cases) and sum(out[i] == w for i, w in want.items()) >= 0.85 * len(want)
    assert all(out[i] in ([], want[i]) for i in want) and not any(out[i] for i in range(len(cases), len(texts)))
    red = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    assert all(red[i] == cases[i][0] + "[SECRET]" + cases[i][2] for i in want if out[i])


def test_decontamination(spark, odd, empty):
    rng = random.Random(8)
    items = [(i, _prose(rng, 30)) for i in range(12)] + [(50, None), (51, ""), (52, "short"), (0, "again"), (None, "no id here at all")]
    rows = []
    for i in range(12):
        t = list(items[i][1])
        for _ in range(i):
            t[rng.randrange(len(t))] = "#"
        rows.append((i, _prose(rng, 40) + "\n" + "".join(t) + " " + _prose(rng, 10)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 200):
        got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_passages(docs, bench, block_chars=block).collect()}
        want = {i for i in range(12) if sum(a != b for a, b in zip(items[i][1], rows[i][1].split("\n")[1])) <= decontamination.allowed(len(items[i][1]), 0.1)}
        assert {k for k, _ in got} == want and all(a == b for a, b in got)
        assert rows[0][1][got[0, 0]["start"]:got[0, 0]["end"]] == items[0][1] and got[0, 0]["edits"] == 0
    assert {r["doc_id"] for r in decontamination.clean(docs, bench).collect()} == set(range(12)) - want
    assert decontamination.find_passages(odd, bench).count() == 0 and decontamination.clean(odd, bench).count() == odd.count()
    assert decontamination.clean(empty, bench).count() == 0 and decontamination.find_passages(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("scores, label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifiers_held_out(spark, odd, empty, scores, label):
    docs, labels = table(spark, SF.replace("0.001", "0.01"), "documents"), table(spark, SF.replace("0.001", "0.01"), "labels")
    got = scores(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert got.score.between(0, 1).all() and len(held) > 30
    assert (held.predicted == held[label]).mean() > 0.9
    parts, at = (5, 0) if label == "quality" else (3, 1)
    assert all((zlib.crc32(str(i).encode()) % parts == at) == h for i, h in zip(got.doc_id, got.held_out))
    # Labels of held-out rows have no influence.
    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == at, 1 - F.col(label)).otherwise(F.col(label)))
    again = scores(docs, flipped).toPandas().merge(got, on="doc_id")
    assert np.allclose(again.score_x, again.score_y)
    marked = odd.select("doc_id").where("doc_id >= 20").withColumn(label, (F.col("doc_id") % 2).cast("int"))
    out = scores(odd, marked).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert scores(empty, labels).count() == 0


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))


def test_vocabularies_hold_the_same_ids():
    import json
    files = vocabulary_files()
    with open(files[1], "rb") as f:
        assert len({base64.b64decode(line.split()[0]) for line in f}) == len(json.load(open(files[0]))["model"]["vocab"])

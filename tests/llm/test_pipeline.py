"""The pipeline's stages on the smallest tables, against what each promises."""

import re

import corpus_pipeline
from cirro.llm.queries import table
from test_operators_helpers import base_spans, grams

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    bench = [r["text"].lower() for r in table(spark, SF, "benchmark").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    last = [name for name, _ in corpus_pipeline.STAGES][-1]
    for name, step in corpus_pipeline.STAGES:
        out = corpus_pipeline.stage(step(spark, docs, SF), name)
        rows = out.collect()
        if name == last:
            assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
            break
        assert out.columns == docs.columns
        text = {r["doc_id"]: r["text"] for r in rows}
        if name == "near_duplicates":
            sets = [grams(t) for t in text.values()]
            assert not any(x and y and len(x & y) >= 0.8 * len(x | y) for i, x in enumerate(sets) for y in sets[:i])
            assert {frozenset(grams(before[r["doc_id"]])) for r in docs.collect()} >= {frozenset(s) for s in sets}
        if name == "decontamination":
            flat = {k: re.sub(r"\s", " ", t.lower()) for k, t in text.items()}
            assert not any(b in t for b in bench for t in flat.values())
        if name == "secrets":
            assert not any(base_spans(t) for t in text.values()) and len(text) == docs.count()
        docs = out


def _classes(rows):
    """Smallest row of each class of texts that are 0.8 alike in word 5-grams."""
    sets = [grams(t) for _, t in rows]
    low = list(range(len(rows)))
    links = [(i, j) for i, x in enumerate(sets) for j in range(i) if x and sets[j] and len(x & sets[j]) >= 0.8 * len(x | sets[j])]
    for _ in range(40):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    return low


def test_kept_documents_of_each_stage(spark):
    """What each stage keeps, against plain versions: no clean document is lost."""
    from collections import Counter

    from cirro.llm import decontamination, quality, secret_scan
    from test_growth import least_edits, masked
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    bench = [(r["item_id"], r["text"].lower()) for r in table(spark, SF, "benchmark").collect()]
    steps = dict(corpus_pipeline.STAGES)

    def run(name, frame):
        out = corpus_pipeline.stage(steps[name](spark, frame, SF), name)
        return out, {r["doc_id"]: r["text"] for r in out.collect()}

    first, kept = run("quality", docs)
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    assert set(kept) == {i for i, s in scores.items() if s >= 0.3}
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [i for i in scores if marked.get(i) == 1]
    assert len(good) > 20 and sum(i in kept for i in good) >= 0.9 * len(good)

    second, left = run("near_duplicates", first)
    rows = sorted(kept.items())
    low = _classes(rows)
    assert Counter(rows[i][0] in left for i in range(len(rows)))[True] == len(set(low))
    for i in set(low):                                                        # one of each class stays
        assert sum(rows[j][0] in left for j in range(len(rows)) if low[j] == i) == 1

    third, clean = run("decontamination", second)
    flat = {i: re.sub(r"\s", " ", t.lower()) for i, t in left.items()}
    holds = {i for i, t in flat.items() for _, b in bench
             if re.sub(r"\s", " ", b) in t or least_edits(re.sub(r"\s", " ", b), t) <= decontamination.allowed(len(b), 0.1)}
    assert set(clean) == set(left) - holds

    fourth, safe = run("secrets", third)
    found = {r["row"]["doc_id"]: [(s["start"], s["end"]) for s in r["found"]] for r in secret_scan.scan(third).collect()}
    assert set(safe) == set(clean) and all(safe[i] == masked(t, found[i]) for i, t in clean.items())
    assert all({(s, e) for s, _, e in base_spans(t)} <= set(found[i]) for i, t in clean.items())

    pieces = steps["packing"](spark, fourth, SF).collect()
    sizes = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert set(sizes) == set(safe) and Counter({i: n for i, n in sizes.items()}) == sum((Counter({r["doc_id"]: r["length"]}) for r in pieces), Counter())


def test_stages_on_odd_rows(spark):
    """Null, empty, very long, repeated and tied rows, further columns whose names clash, and no rows at all."""
    from pyspark.sql import functions as F
    docs = table(spark, SF, "documents")
    text = docs.orderBy("doc_id").first()["text"]
    odd = [(None, None), (None, ""), (9001, None), (9002, ""), (9003, "plain words " * 30000), (9004, text), (9004, text), (9005, text), (9006, " \n\t ")]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in odd], docs.schema)
    extra = docs.union(rows).withColumn("score", F.lit("s")).withColumn("row", F.lit(1)).withColumn("found", F.lit(2)).withColumn("class_id", F.lit(3))
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage(step(spark, extra, SF), name)
        assert out.columns == extra.columns and out.where("score = 's' AND found = 2").count() == out.count()
        if name in ("decontamination", "secrets"):
            assert out.where("doc_id IS NULL").count() == 2 and out.where("doc_id = 9003").count() == 1
        if name == "near_duplicates":
            assert out.where("doc_id IN (9004, 9005)").count() + out.where(F.col("text") == text).where("doc_id < 9000").count() == 1
            assert out.where("doc_id IS NULL").count() == 2 and out.where("doc_id IN (9001, 9002, 9006)").count() == 3
        assert step(spark, extra.limit(0), SF).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, extra, SF)
    assert packed.where("doc_id IS NULL").count() == 2 and packed.select("doc_id").distinct().count() == extra.select("doc_id").distinct().count()

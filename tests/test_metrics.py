"""Metrics against brute force and the transcript's numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirro.functions import grades as GR
from cirro.operators import metrics as M


def _rows(spark, y, p, g="g"):
    return spark.createDataFrame([(g, int(a), float(b)) for a, b in zip(y, p)], "grp string, label int, p double")


def test_confusion_fixture(spark):
    conf = spark.createDataFrame([(37, 0, 200, 63), (0, 37, 0, 263)], "tn long, fp long, fn long, tp long")
    m = M.class_metrics(conf, beta=2.0).collect()
    assert round(m[0]["f1"], 3) == 0.387 and round(m[0]["fbeta"], 3) == 0.283
    assert round(m[1]["f1"], 3) == 0.934 and round(m[1]["fbeta"], 3) == 0.973
    assert round(m[1]["accuracy"], 3) == 0.877


def _auc_brute(y, p):
    pos = [b for a, b in zip(y, p) if a == 1]
    neg = [b for a, b in zip(y, p) if a == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_auc_ap_threshold_quantile_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    p = np.round(np.clip(y * 0.2 + rng.random(300) * 0.8, 0, 1), 2)
    df = _rows(spark, y, p)
    auc = M.auc_roc(df, ["grp"]).first()["auc"]
    assert auc == pytest.approx(_auc_brute(y, p))
    # average precision over distinct scores, descending
    ap = 0.0
    for t in sorted(set(p), reverse=True):
        sel = p >= t
        tp, fp = int((y[sel] == 1).sum()), int((y[sel] == 0).sum())
        ap += ((y[p == t] == 1).sum() / y.sum()) * tp / (tp + fp)
    assert M.average_precision(df, ["grp"]).first()["average_precision"] == pytest.approx(ap)
    # the reference's 99-step sweep, strict improvement
    best_s, best_t = 0.0, 0.5
    for t in np.linspace(0.01, 0.99, 99):
        pred = (p >= t).astype(int)
        tp = int(((pred == 1) & (y == 1)).sum()); fp = int(((pred == 1) & (y == 0)).sum())
        fn = int(((pred == 0) & (y == 1)).sum())
        den = 5 * tp + 4 * fn + fp
        s = 5 * tp / den if den else 0.0
        if s > best_s:
            best_s, best_t = s, t
    bt = M.best_threshold(df, ["grp"]).first()
    assert bt["threshold"] == pytest.approx(best_t) and bt["score"] == pytest.approx(best_s)
    q = M.conformal_quantile(df, ["grp"]).first()["conformal_q"]
    assert q == pytest.approx(float(np.quantile(np.abs(p - y), 0.8)))


def test_trust_transcript_cases(spark):
    df = spark.createDataFrame([(1.0, 0.239, 0.0, 1, "HIGH", "NO RAIN", 0.1, 0.9),
                                (1.0, 0.117, 0.611, 8, "VERY HIGH", "RAIN", 0.8, 0.9)],
                               "q double, w double, r double, n int, c string, o string, p double, v double")
    t = df.select(GR.trust_score("q", "w", "r", "n", "c", "o", "p", "v").alias("t")).collect()
    # case 1: 89 % in the reference with one model; 6/9 = 67 % under Q12
    assert t[0]["t"]["trust_pct"] == pytest.approx(600 / 9) and t[0]["t"]["trust_status"] == "MODERATE"
    assert t[1]["t"]["trust_pct"] == pytest.approx(68.75) and t[1]["t"]["trust_status"] == "MODERATE"


def test_grades_rules(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.45,), (0.75,)], "x double")
    out = df.select(GR.confidence_grade("x").alias("c"), GR.clamp_threshold(F.col("x")).alias("t"),
                    GR.regime_label("x").alias("r"), GR.outcome_three_level("x").alias("o")).collect()
    assert [r["c"] for r in out] == ["VERY HIGH", "HIGH", "MEDIUM", "LOW", "LOW"]
    assert [r["t"] for r in out] == [0.25, 0.2, 0.3, 0.35, 0.35]
    assert [r["r"] for r in out] == [0, 0, 1, 1, 2]
    assert [r["o"] for r in out] == ["CLEAR", "CLEAR", "POSSIBLE", "POSSIBLE", "RAIN"]

"""Grades and rules as Column expressions.

These are per-row rules, so they are plain ``when`` chains that stay in
whole-stage codegen.  The thresholds below are the reference's fixed
values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (reference rules).
REGIME_EDGES = (0.3, 0.7)                    # volatility -> state 0 / 1 / 2
CONFIDENCE_EDGES = (0.15, 0.25, 0.35)        # interval width -> VERY HIGH / HIGH / MEDIUM / LOW
THRESHOLD_CLAMP = (0.4, 0.35, 0.2, 0.25)     # > 0.4 -> 0.35 ; < 0.2 -> 0.25
QUALITY_POINTS = ((0.95, 3.0), (0.9, 2.5), (0.85, 2.0), (None, 1.0))
WIDTH_POINTS = ((0.15, 2.0), (0.25, 1.5), (0.35, 1.0), (None, 0.0))
RANGE_POINTS = ((0.1, 2.0), (0.2, 1.5), (0.3, 1.0), (None, 0.0))
TRUST_EDGES = ((80, "HIGH"), (65, "MODERATE"), (50, "LOW"), (None, "VERY LOW"))
THREE_LEVEL = ((60, "RAIN"), (30, "POSSIBLE"), (None, "CLEAR"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def regime_label(vol) -> Column:
    """M9: volatility < 0.3 -> 0, < 0.7 -> 1, else (or unknown) 2."""
    v = _c(vol)
    return (F.when(v < REGIME_EDGES[0], 0).when(v < REGIME_EDGES[1], 1).otherwise(2)).cast("int")


def confidence_grade(width) -> Column:
    """Interval width -> VERY HIGH / HIGH / MEDIUM / LOW."""
    w = _c(width)
    a, b, c = CONFIDENCE_EDGES
    return (F.when(w < a, "VERY HIGH").when(w < b, "HIGH").when(w < c, "MEDIUM").otherwise("LOW"))


def clamp_threshold(t) -> Column:
    """A tuned threshold above 0.4 becomes 0.35, below 0.2 becomes 0.25."""
    t = _c(t)
    hi, hi_to, lo, lo_to = THRESHOLD_CLAMP
    return F.when(t > hi, F.lit(hi_to)).when(t < lo, F.lit(lo_to)).otherwise(t)


def conformal_interval(p, q) -> tuple[Column, Column, Column]:
    """[max(0, p - q), min(1, p + q)] and its width."""
    lo = F.greatest(F.lit(0.0), _c(p) - _c(q))
    hi = F.least(F.lit(1.0), _c(p) + _c(q))
    return lo, hi, hi - lo


def _points(x: Column, table, strict_gt: bool) -> Column:
    expr = None
    for edge, pts in table:
        if edge is None:
            expr = (expr.otherwise(F.lit(pts)) if expr is not None else F.lit(pts))
            break
        cond = (x > edge) if strict_gt else (x < edge)
        expr = F.when(cond, F.lit(pts)) if expr is None else expr.when(cond, F.lit(pts))
    return expr


def trust_score(quality, width, prob_range, n_models, confidence, outcome, p,
                volatility) -> Column:
    """Trust points -> percent and status, with the list of reasons.

    quality 3/2.5/2/1, width 2/1.5/1/0, model range 2/1.5/1/0 (no points
    and no agreement reading with fewer than two models, Q12), grade
    1/0.5/0; NO RAIN with p < 0.2 adds one point to score and maximum;
    volatility > 0.7 subtracts 0.5.  Returns struct(trust_pct, trust_status,
    reasons).
    """
    q, w, r, n = _c(quality), _c(width), _c(prob_range), _c(n_models)
    conf, out, p_, vol = _c(confidence), _c(outcome), _c(p), _c(volatility)
    qp = _points(q, QUALITY_POINTS, strict_gt=True)
    wp = _points(w, WIDTH_POINTS, strict_gt=False)
    has_agree = n >= 2
    rp = F.when(has_agree, _points(r, RANGE_POINTS, strict_gt=False)).otherwise(F.lit(0.0))
    gp = F.when(conf.isin("VERY HIGH", "HIGH"), 1.0).when(conf == "MEDIUM", 0.5).otherwise(0.0)
    bonus = F.when((out == "NO RAIN") & (p_ < 0.2), 1.0).otherwise(0.0)
    pen = F.when(vol > 0.7, 0.5).otherwise(0.0)
    score = qp + wp + rp + gp + bonus - pen
    max_score = F.lit(8.0) + bonus
    pct = score / max_score * 100
    status = F.when(pct >= 80, "HIGH").when(pct >= 65, "MODERATE").when(pct >= 50, "LOW").otherwise("VERY LOW")
    reasons = F.array_compact(F.array(
        F.when(q > 0.95, "excellent data quality").when(q > 0.9, "good data quality")
         .when(q > 0.85, "acceptable data quality").otherwise("fair data quality"),
        F.when(w < 0.15, "very narrow interval").when(w < 0.25, "narrow interval")
         .when(w < 0.35, "moderate interval").otherwise("wide interval"),
        F.when(~has_agree, "agreement not measurable (fewer than two models)")
         .when(r < 0.1, "excellent model agreement").when(r < 0.2, "good model agreement")
         .when(r < 0.3, "moderate model agreement").otherwise("poor model agreement"),
        F.concat(conf, F.lit(" confidence")),
        F.when(bonus > 0, "very low event probability (<20%)"),
        F.when(pen > 0, "high volatility"),
    ))
    return F.struct(pct.alias("trust_pct"), status.alias("trust_status"), reasons.alias("reasons"))


def outcome_three_level(p) -> Column:
    """Percent >= 60 RAIN, >= 30 POSSIBLE, else CLEAR."""
    pct = _c(p) * 100
    return F.when(pct >= 60, "RAIN").when(pct >= 30, "POSSIBLE").otherwise("CLEAR")


def v1_confidence(prob_std, auc, final_p) -> Column:
    """0.4*agreement + 0.3*AUC + 0.3*decisiveness, agreement =
    1 - min(std, 0.5), decisiveness = |p - 0.5| * 2; > 0.7 HIGH, > 0.5
    MEDIUM, else LOW.  Returns struct(score, grade)."""
    agreement = 1 - F.least(_c(prob_std), F.lit(0.5))
    decis = F.abs(_c(final_p) - 0.5) * 2
    s = 0.4 * agreement + 0.3 * _c(auc) + 0.3 * decis
    return F.struct(s.alias("confidence_score"),
                    F.when(s > 0.7, "HIGH").when(s > 0.5, "MEDIUM").otherwise("LOW").alias("confidence"))


def weighted_vote(p_rf, p_xgb, p_gb, auc_rf, auc_xgb, f1_gb, regime) -> Column:
    """M24 (v1 blend): boosted probabilities RF*1.5, XGB*2.5, GB*1 weighted by
    0.3*AUC_rf, 0.4*AUC_xgb, 0.3*F1_gb, clipped; x1.2 when the regime
    probability > 0.7; 0.8*p + 0.2*regime; clipped again."""
    w1, w2, w3 = 0.3 * _c(auc_rf), 0.4 * _c(auc_xgb), 0.3 * _c(f1_gb)
    den = w1 + w2 + w3
    e = F.when(den != 0, (w1 * _c(p_rf) * 1.5 + w2 * _c(p_xgb) * 2.5 + w3 * _c(p_gb)) / den)
    e = F.greatest(F.lit(0.0), F.least(F.lit(1.0), e))
    reg = _c(regime)
    e = F.when(reg > 0.7, e * 1.2).otherwise(e)
    f = F.when(reg.isNotNull(), 0.8 * e + 0.2 * reg).otherwise(e)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))

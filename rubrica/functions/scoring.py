"""Scoring rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rubrica.config import DEFAULTS, Thresholds


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def remap(raw) -> Column:
    """Cosine in [-1, 1] to [0, 1] at four decimals; exactly 0 when nothing was retrieved."""
    return F.coalesce(F.round((_c(raw) + 1) / 2, 4), F.lit(0.0))


def boost(similarity, underlined, t: Thresholds = DEFAULTS) -> Column:
    """Raise the similarity of an underlined top chunk, never above 1."""
    s = _c(similarity)
    lifted = F.round(F.least(s * F.lit(t.underline_boost), F.lit(1.0)), 4)
    return F.when(F.coalesce(_c(underlined), F.lit(False)), lifted).otherwise(s)


def similarity_band(similarity, t: Thresholds = DEFAULTS) -> Column:
    """Verdict of the similarity alone."""
    s = _c(similarity)
    return F.when(s >= t.full_credit, "COVERED").when(s >= t.partial_credit, "PARTIAL").otherwise("MISSING")


def concept_status(similarity, verdict, t: Thresholds = DEFAULTS) -> Column:
    """A covered verdict needs the similarity behind it; the other verdicts stand."""
    v = _c(verdict)
    return (
        F.when((v == "COVERED") & (_c(similarity) >= t.full_credit), "COVERED")
        .when(v.isin("COVERED", "PARTIAL"), "PARTIAL")
        .otherwise("MISSING")
    )


def status_factor(status) -> Column:
    s = _c(status)
    return (
        F.when(s == "COVERED", F.lit("1.0").cast("decimal(2,1)"))
        .when(s == "PARTIAL", F.lit("0.5").cast("decimal(2,1)"))
        .otherwise(F.lit("0.0").cast("decimal(2,1)"))
    )


def marks_for(weight, max_marks, factor) -> Column:
    """weight x maximum x factor as decimals, half up to two places."""
    product = _c(weight).cast("decimal(10,8)") * _c(max_marks).cast("decimal(6,2)") * _c(factor).cast("decimal(2,1)")
    return product.cast("decimal(6,2)")


def composite_confidence(ocr, passes, retrieval, t: Thresholds = DEFAULTS) -> Column:
    """Weighted sum of reading quality, pass agreement and retrieval agreement, clamped to [0, 1]."""
    total = (
        F.lit(t.weight_ocr) * _c(ocr) + F.lit(t.weight_passes) * _c(passes) + F.lit(t.weight_retrieval) * _c(retrieval)
    )
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 4)


def confidence_band(confidence, t: Thresholds = DEFAULTS) -> Column:
    c = _c(confidence)
    return F.when(c >= t.green, "GREEN").when(c >= t.orange, "ORANGE").otherwise("RED")

"""Class summary of all exams in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rubrica.operators.results import (
    BUCKET_EDGES,
    band_counts,
    concept_miss_rate,
    escalation_rate,
    exclude_failed,
    mark_distribution,
    most_missed,
    sheet_totals,
)


def exam_marks(sheets: DataFrame, ev: DataFrame) -> DataFrame:
    """Live sheets with their totals; a sheet without evaluations counts as 0."""
    live = exclude_failed(sheets).select("sheet_id", "exam_id", "status", "band", "confidence")
    return live.join(sheet_totals(ev).select("sheet_id", "total_marks"), "sheet_id", "left")


def exam_misses(sheets: DataFrame, concept_scores: DataFrame) -> DataFrame:
    """Verdict counts per exam and concept text.

    Scores meet their sheet first: counting per sheet and text beforehand would shuffle nearly every score for little
    reduction. The counts per exam and text are then taken map-side, so a hot exam or text costs nothing extra; a hot
    sheet is one oversized join partition, which AQE splits.
    """
    live = exclude_failed(sheets).select("sheet_id", "exam_id")
    return concept_miss_rate(concept_scores.select("sheet_id", "concept_text", "status").join(live, "sheet_id"))


def exam_escalation(sheets: DataFrame, annotations: DataFrame) -> DataFrame:
    """Escalation rate per exam from per-sheet counts."""
    per_sheet = annotations.groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("resolved_by") == "VLM").alias("v")
    )
    live = exclude_failed(sheets).select("sheet_id", "exam_id")
    return (
        per_sheet.join(live, "sheet_id")
        .groupBy("exam_id")
        .agg(F.round(F.sum("v").cast("double") / F.sum("n"), 4).alias("vlm_escalation_rate"))
    )


def exam_summary(
    exams: DataFrame, sheets: DataFrame, ev: DataFrame, concept_scores: DataFrame, annotations: DataFrame
) -> DataFrame:
    """One row per exam: counts, bands, histogram, most missed concepts, mean confidence, escalation rate."""
    marks = exam_marks(sheets, ev)
    edges = list(zip(BUCKET_EDGES, BUCKET_EDGES[1:], strict=False))
    total = F.coalesce("total_marks", F.lit(0))
    head = marks.groupBy("exam_id").agg(
        F.count(F.lit(1)).alias("sheet_count"),
        F.count_if(F.col("status") == "APPROVED").alias("approved_count"),
        *[F.count_if(F.col("band") == b.upper()).alias(b) for b in ("green", "orange", "red")],
        *[F.count_if((total >= lo) & (total < hi)).alias(f"marks_{lo}_{hi - 1}") for lo, hi in edges],
        F.round(F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double") / F.count(F.lit(1)), 4).alias(
            "avg_confidence"
        ),
    )
    worst = most_missed(exam_misses(sheets, concept_scores))
    listed = worst.groupBy("exam_id").agg(
        F.expr(
            "listagg(concat(concept_text, ':', missing, '/', partial, '/', covered), '; ')"
            " WITHIN GROUP (ORDER BY rank)"
        ).alias("most_missed")
    )
    zero = [c for c in head.columns if c != "exam_id"]
    return (
        exams.select("exam_id")
        .join(head, "exam_id", "left")
        .join(listed, "exam_id", "left")
        .join(exam_escalation(sheets, annotations), "exam_id", "left")
        .na.fill(0, zero + ["vlm_escalation_rate"])
        .na.fill("", ["most_missed"])
    )


__all__ = [
    "band_counts",
    "escalation_rate",
    "exam_escalation",
    "exam_marks",
    "exam_misses",
    "exam_summary",
    "mark_distribution",
]

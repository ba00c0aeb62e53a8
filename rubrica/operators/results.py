"""Marks, totals and report rows over stored evaluations, concept scores and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rubrica.config import DEFAULTS, MARK_KINDS, STAGES, Thresholds
from rubrica.functions.scoring import confidence_band

MARKS = "decimal(6,2)"


def effective_mark() -> Column:
    """The teacher's mark where one is set, else the machine's."""
    return F.coalesce("override_marks", "auto_marks")


def with_effective_marks(ev: DataFrame) -> DataFrame:
    return ev.withColumn("effective_marks", effective_mark())


def question_marks(concept_scores: DataFrame, by=("sheet_id", "question_id")) -> DataFrame:
    """Mark of a question: the sum of its concept marks."""
    return concept_scores.groupBy(*by).agg(F.coalesce(F.sum("marks"), F.lit(0)).alias("auto_marks"))


def sheet_totals(ev: DataFrame) -> DataFrame:
    """Totals per sheet from effective marks."""
    return ev.groupBy("sheet_id").agg(
        F.sum(effective_mark()).alias("total_marks"),
        F.sum("max_marks").alias("max_marks"),
        F.count(F.lit(1)).alias("questions"),
    )


def sheet_confidence(sheets: DataFrame, ev: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Unweighted mean over a sheet's questions, 0 when it has none, and its band."""
    mean = ev.groupBy("sheet_id").agg(
        (F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double") / F.count("confidence")).alias("m")
    )
    return (
        sheets.select("sheet_id")
        .join(mean, "sheet_id", "left")
        .select("sheet_id", F.coalesce("m", F.lit(0.0)).alias("confidence"))
        .withColumn("band", confidence_band("confidence", t))
    )


def exclude_failed(sheets: DataFrame) -> DataFrame:
    return sheets.where("status <> 'FAILED'")


def band_counts(sheets: DataFrame, by: str = "exam_id") -> DataFrame:
    """Counts per band with absent bands kept as zero."""
    return sheets.groupBy(by).agg(
        *[F.count_if(F.col("band") == b).alias(b.lower()) for b in ("GREEN", "ORANGE", "RED")]
    )


# --- fixed values: histogram edges, half-open -----------------------------------------------------
BUCKET_EDGES = (0, 5, 9, 13, 17, 21)


def _buckets(edges=BUCKET_EDGES):
    return [(lo, hi, f"{lo}-{hi - 1}") for lo, hi in zip(edges, edges[1:], strict=False)]


def mark_distribution(totals: DataFrame, edges=BUCKET_EDGES, by: str = "exam_id") -> DataFrame:
    """Histogram of sheet totals per group, empty buckets present, totals past the last edge dropped.

    One conditional count per bucket keeps it a single map-side aggregation; the handful of counts is then unpivoted.
    """
    v = F.coalesce(F.col("total_marks"), F.lit(0))
    wide = totals.groupBy(by).agg(*[F.count_if((v >= lo) & (v < hi)).alias(label) for lo, hi, label in _buckets(edges)])
    return wide.unpivot([by], [label for *_, label in _buckets(edges)], "bucket", "count")


def concept_miss_rate(concept_scores: DataFrame, by=("exam_id", "concept_text")) -> DataFrame:
    """Counts of each verdict per concept text; equal texts of different questions merge."""
    return concept_scores.groupBy(*by).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("MISSING", "PARTIAL", "COVERED")]
    )


def most_missed(miss: DataFrame, n: int = 8, by: str = "exam_id") -> DataFrame:
    """The n concepts missed most in each exam; ties by text."""
    w = Window.partitionBy(by).orderBy(F.desc("missing"), "concept_text")
    return miss.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def escalation_rate(annotations: DataFrame, by: str = "exam_id") -> DataFrame:
    """Share of annotations a model had to resolve."""
    return annotations.groupBy(by).agg(
        F.count(F.lit(1)).alias("annotations"),
        F.round(F.avg((F.col("resolved_by") == "VLM").cast("double")), 4).alias("vlm_escalation_rate"),
    )


def annotation_counts(annotations: DataFrame, by=("sheet_id", "question_id")) -> DataFrame:
    """Annotations per kind of one answer; kinds that do not occur have no row."""
    return annotations.where(F.col("kind").isin(*MARK_KINDS)).groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n"))


def escalated_counts(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("sheet_id").agg(F.count_if(F.col("resolved_by") == "VLM").alias("escalated"))


def concept_header(concept_scores: DataFrame, by=("sheet_id", "question_id")) -> DataFrame:
    """Covered n of m, and earned of available marks."""
    return concept_scores.groupBy(*by).agg(
        F.count_if(F.col("status") == "COVERED").alias("covered"),
        F.count(F.lit(1)).alias("concepts"),
        F.sum("marks").alias("earned"),
        F.sum("max_marks").alias("available"),
    )


def exam_cards(exams: DataFrame, questions: DataFrame, sheets: DataFrame, ev: DataFrame) -> DataFrame:
    """Per exam: questions, sheets of any status, and the mean total of sheets that did not fail."""
    n_questions = questions.groupBy("exam_id").agg(F.count(F.lit(1)).alias("question_count"))
    per_exam = (
        sheets.select("exam_id", "sheet_id", "status")
        .join(sheet_totals(ev).select("sheet_id", "total_marks"), "sheet_id", "left")
        .groupBy("exam_id")
        .agg(
            F.count(F.lit(1)).alias("sheet_count"),
            F.sum(F.when(F.col("status") != "FAILED", F.coalesce("total_marks", F.lit(0)))).alias("s"),
            F.count_if(F.col("status") != "FAILED").alias("n"),
        )
    )
    return (
        exams.select("exam_id")
        .join(n_questions, "exam_id", "left")
        .join(per_exam, "exam_id", "left")
        .select(
            "exam_id",
            F.coalesce("question_count", F.lit(0)).alias("question_count"),
            F.coalesce("sheet_count", F.lit(0)).alias("sheet_count"),
            F.round(F.when(F.col("n") > 0, F.col("s").cast("double") / F.col("n")), 6).alias("avg_marks"),
        )
    )


def short_label(col: str = "concept_text") -> Column:
    """Chart label: long texts cut to forty characters and an ellipsis."""
    c = F.col(col)
    return F.when(F.length(c) > 42, F.concat(F.substring(c, 1, 40), F.lit("…"))).otherwise(c)


def with_stage_rank(df: DataFrame) -> DataFrame:
    """Position of the stage and whole-percent progress."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage")) - 1
    return df.withColumn("stage_rank", rank).withColumn(
        "progress_pct", F.round(F.col("stage_rank") * 100 / (len(STAGES) - 1)).cast("bigint")
    )


def with_elapsed(df: DataFrame, now: Column) -> DataFrame:
    """Seconds the current run has taken; null until a run has started."""
    return df.withColumn("elapsed_s", F.timestamp_diff("SECOND", F.col("last_run_started_at"), now))

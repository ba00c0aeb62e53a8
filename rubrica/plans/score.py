"""Score answers against their rubrics: chunks, retrieval, votes, marks, confidence, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rubrica.config import DEFAULTS, Thresholds
from rubrica.functions.scoring import (
    boost,
    composite_confidence,
    concept_status,
    confidence_band,
    marks_for,
    remap,
    similarity_band,
    status_factor,
)
from rubrica.functions.text import chunk_text, keyword_verdict, keywords, strip, tag_spans
from rubrica.functions.vectors import hash_embed
from rubrica.operators.retrieval import majority_vote, similarity_join, top_k


def retrieve(answers: DataFrame, concepts: DataFrame, t: Thresholds = DEFAULTS, embed=None) -> DataFrame:
    """Per (answer, concept): similarity of the top chunk and the top chunks joined as evidence.

    `answers`: answer_id, question_id, text[, spans]; `concepts`: question_id, concept_id, text, weight, embedding.
    `embed(df, text_col)` appends `embedding`; without one the content hash is used.
    """
    embed = embed or hash_embed
    keep = ["answer_id", "question_id"] + [c for c in ("spans",) if c in answers.columns]
    rows = chunk_text(answers.where(strip("text") != ""), "text", keep, t)
    rows = tag_spans(rows).drop("spans") if "spans" in keep else rows.withColumn("underlined", F.lit(False))
    # Vectors are made per row: equal texts cost a repeated hash, where de-duplicating them would cost a shuffle.
    cands = embed(rows.drop("start", "end"), "text").withColumnRenamed("embedding", "c_vec")
    queries = concepts.select("question_id", "concept_id", F.col("embedding").alias("q_vec"))
    best = top_k(similarity_join(queries, cands, ["question_id"]), ["answer_id", "concept_id"], t.top_k)
    return (
        best.groupBy("answer_id", "concept_id")
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("raw"))).alias("raw"),
            F.bool_or((F.col("rank") == 1) & F.col("underlined")).alias("underlined"),
            F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY rank)").alias("evidence"),
        )
        .withColumn("similarity", boost(remap("raw"), "underlined", t))
        .drop("raw", "underlined")
    )


def prepared(answers: DataFrame, concepts: DataFrame, t: Thresholds = DEFAULTS, embed=None) -> DataFrame:
    """One row per answer and concept of its question, blank answers included, with similarity and evidence."""
    spine = answers.select(
        "answer_id", "question_id", "max_marks", "ocr_quality", (strip("text") == "").alias("blank")
    ).join(concepts.select("question_id", "concept_id", "ord", "weight", F.col("text").alias("concept_text")), "question_id")
    return spine.join(retrieve(answers, concepts, t, embed), ["answer_id", "concept_id"], "left").withColumns(
        {"similarity": F.coalesce("similarity", F.lit(0.0)), "evidence": F.coalesce("evidence", F.lit(""))}
    )


def keyword_votes(rows: DataFrame) -> DataFrame:
    """Deterministic stand-in for a model's coverage verdict: one pass of keyword overlap."""
    verdict = keyword_verdict(keywords("concept_text"), keywords("evidence"))
    return rows.where(~F.col("blank")).select(
        "answer_id", "concept_id", F.lit(1).alias("pass_no"), verdict.alias("verdict")
    )


def evaluation_runs(rows: DataFrame, votes: DataFrame | None) -> DataFrame:
    """The passes behind each concept's verdict: answer_id, concept_id, pass_no (from 1), verdict, raw_response.

    `rows` are those of `prepared`. Votes of a model keep its reply where the vote table has one; without a vote table the
    keyword pass is recorded. Blank answers are not asked about and have no passes.
    """
    if votes is None:
        taken = keyword_votes(rows)
    else:
        taken = votes.join(rows.where(~F.col("blank")).select("answer_id", "concept_id"), ["answer_id", "concept_id"], "left_semi")
    reply = F.col("raw_response") if "raw_response" in taken.columns else F.lit("")
    return taken.select("answer_id", "concept_id", F.col("pass_no").cast("int").alias("pass_no"), "verdict", reply.alias("raw_response"))


def concept_scores(rows: DataFrame, votes: DataFrame | None, t: Thresholds = DEFAULTS) -> DataFrame:
    """Status, marks and evidence per answer and concept.

    `votes`: answer_id, concept_id, pass_no, verdict. Without a vote table the single keyword pass is taken in place,
    which needs neither an aggregation nor a join.
    """
    if votes is None:
        verdict = F.when(~F.col("blank"), keyword_verdict(keywords("concept_text"), keywords("evidence")))
        joined = rows.withColumn("verdict", verdict).withColumn("agreement", F.lit(1.0)).withColumn(
            "disagreed", F.lit(False)
        )
    else:
        joined = rows.join(majority_vote(votes, ["answer_id", "concept_id"]).drop("passes"), ["answer_id", "concept_id"], "left")
    status = F.when(F.col("blank"), "MISSING").otherwise(concept_status("similarity", F.coalesce("verdict", F.lit("MISSING")), t))
    blank_max = F.round(F.col("weight") * F.col("max_marks").cast("double"), 2).cast("decimal(6,2)")
    return (
        joined.withColumn("status", status)
        .withColumn("marks", marks_for("weight", "max_marks", status_factor("status")))
        .withColumn(
            "concept_max", F.when(F.col("blank"), blank_max).otherwise(marks_for("weight", "max_marks", F.lit(1)))
        )
        .withColumn("evidence", F.when(F.col("status") == "MISSING", "").otherwise(F.col("evidence")))
        .withColumn("agrees", F.coalesce(F.col("verdict") == similarity_band("similarity", t), F.lit(False)))
        .withColumn("disagreed", F.coalesce("disagreed", F.lit(False)))
        .withColumn("agreement", F.coalesce("agreement", F.lit(1.0)))
    )


# --- fixed values: feedback sentences --------------------------------------------------------------
_COVERS = "The answer clearly covers: "
_ENGAGES = "The answer engages with the question but doesn't clearly cover a scored concept."
_LACKS = "Missing or only partially covered: "
_COMPLETE = "No concepts were missed."
_REVISIT = "Revisit and add detail on: "
_KEEP = "Keep reinforcing the concepts already covered with a worked example."
_BLANK_GAPS = "No answer provided for this question."
_BLANK_SUGGESTION = "Review the relevant concepts."


def _listed(condition: str) -> str:
    return f"listagg(CASE WHEN {condition} THEN concept_text END, '; ') WITHIN GROUP (ORDER BY ord)"


def _feedback_columns(df: DataFrame) -> DataFrame:
    """Three feedback texts from the lists `_covered`, `_weak` and the first weak concept."""
    return df.withColumns(
        {
            "strengths": F.coalesce(F.concat(F.lit(_COVERS), F.nullif("_covered", F.lit("")), F.lit(".")), F.lit(_ENGAGES)),
            "gaps": F.coalesce(F.concat(F.lit(_LACKS), F.nullif("_weak", F.lit("")), F.lit(".")), F.lit(_COMPLETE)),
            "suggestions": F.coalesce(F.concat(F.lit(_REVISIT), F.col("_first_weak"), F.lit(".")), F.lit(_KEEP)),
        }
    )


def feedback_text(scores: DataFrame, by: list[str]) -> DataFrame:
    """Feedback per answer from its concept statuses; a question has at most eight concepts, so the lists are short."""
    lists = scores.groupBy(*by).agg(*_feedback_lists())
    return _feedback_columns(lists).select(*by, "strengths", "gaps", "suggestions")


def _feedback_lists():
    weak = F.col("status") != "COVERED"
    return [
        F.expr(_listed("status = 'COVERED'")).alias("_covered"),
        F.expr(_listed("status <> 'COVERED'")).alias("_weak"),
        F.min_by(F.when(weak, F.col("concept_text")), F.when(weak, F.col("ord"))).alias("_first_weak"),
    ]


def question_results(answers: DataFrame, scores: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Mark, confidence, band and feedback per answer."""
    head = scores.groupBy("answer_id").agg(
        F.sum("marks").alias("auto_marks"),
        F.round(F.sum(F.col("agreement").cast("decimal(10,4)")).cast("double") / F.count(F.lit(1)), 4).alias("passes"),
        F.round(F.avg(F.col("agrees").cast("double")), 4).alias("retrieval"),
        *_feedback_lists(),
    )
    joined = _feedback_columns(
        answers.select("answer_id", "question_id", "max_marks", "ocr_quality", (strip("text") == "").alias("blank")).join(
            head, "answer_id", "left"
        )
    )
    confidence = composite_confidence(
        "ocr_quality", F.coalesce("passes", F.lit(1.0)), F.coalesce("retrieval", F.lit(0.0)), t
    )
    blank = F.col("blank")
    return joined.select(
        "answer_id",
        "question_id",
        "max_marks",
        F.when(blank, F.lit(0)).otherwise(F.coalesce("auto_marks", F.lit(0))).cast("decimal(8,2)").alias("auto_marks"),
        F.when(blank, F.lit(1.0)).otherwise(confidence).alias("confidence"),
        F.when(blank, "RED").otherwise(confidence_band(confidence, t)).alias("band"),
        F.when(blank, "").otherwise(F.col("strengths")).alias("strengths"),
        F.when(blank, _BLANK_GAPS).otherwise(F.col("gaps")).alias("gaps"),
        F.when(blank, _BLANK_SUGGESTION).otherwise(F.col("suggestions")).alias("suggestions"),
    )


def score_answers(
    answers: DataFrame,
    concepts: DataFrame,
    votes: DataFrame | None = None,
    t: Thresholds = DEFAULTS,
    embed=None,
) -> tuple[DataFrame, DataFrame]:
    """(concept scores, evaluations) of whole cohorts."""
    scores = concept_scores(prepared(answers, concepts, t, embed), votes, t)
    return scores, question_results(answers, scores, t)

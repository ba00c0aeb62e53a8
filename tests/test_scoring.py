"""Band edges, rounding and confidence, row by row."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rubrica.functions import scoring
from rubrica.plans.score import question_results, concept_scores

BANDS = [
    (0.72, "COVERED", "COVERED"), (0.95, "COVERED", "COVERED"), (0.7199, "COVERED", "PARTIAL"), (0.50, "COVERED", "PARTIAL"),
    (0.10, "COVERED", "PARTIAL"), (0.0, "COVERED", "PARTIAL"), (0.99, "PARTIAL", "PARTIAL"), (0.0, "PARTIAL", "PARTIAL"),
    (0.99, "MISSING", "MISSING"), (0.72, "MISSING", "MISSING"), (0.50, "MISSING", "MISSING"), (0.0, "MISSING", "MISSING"),
]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_concept_status(spark):
    rows = spark.createDataFrame(BANDS, "s double, v string, want string")
    got = rows.withColumn("got", scoring.concept_status("s", "v")).where("got <> want").collect()
    assert got == []


@pytest.mark.parametrize(
    ("weight", "most", "factor", "want"),
    [("0.333333", 10, "1", "3.33"), ("0.333333", 10, "0.5", "1.67"), ("0.25", 5, "0.5", "0.63"), ("0.2", 10, "0", "0.00")],
)
def test_marks(spark, weight, most, factor, want):
    assert one(spark, scoring.marks_for(F.lit(float(weight)), F.lit(most), F.lit(factor))) == Decimal(want)


@pytest.mark.parametrize(("c", "band"), [(0.80, "GREEN"), (0.7999, "ORANGE"), (0.65, "ORANGE"), (0.6499, "RED"), (0.0, "RED")])
def test_confidence_band(spark, c, band):
    assert one(spark, scoring.confidence_band(F.lit(c))) == band


def test_composite_confidence(spark):
    assert one(spark, scoring.composite_confidence(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 1.0
    assert one(spark, scoring.composite_confidence(F.lit(0.8), F.lit(0.6667), F.lit(0.5))) == 0.6717
    assert one(spark, scoring.composite_confidence(F.lit(9.0), F.lit(1.0), F.lit(1.0))) == 1.0


def test_similarity_steps(spark):
    assert one(spark, scoring.remap(F.lit(None).cast("double"))) == 0.0
    assert one(spark, scoring.remap(F.lit(0.0))) == 0.5
    assert one(spark, scoring.boost(F.lit(0.95), F.lit(True))) == 1.0
    assert one(spark, scoring.boost(F.lit(0.66), F.lit(True))) == 0.726
    assert one(spark, scoring.similarity_band(F.lit(0.72))) == "COVERED"
    assert one(spark, scoring.similarity_band(F.lit(0.4999))) == "MISSING"


def test_blank_answer_and_question_without_concepts(spark):
    answers = spark.createDataFrame(
        [("blank", 1, "  ", 10.0, 0.4), ("bare", 2, "text", 10.0, 1.0)],
        "answer_id string, question_id int, text string, max_marks double, ocr_quality double",
    )
    rows = spark.createDataFrame(
        [("blank", 1, 7, 0, "c", 0.333333, 10.0, 0.4, True, 0.0, "")],
        "answer_id string, question_id int, concept_id int, ord int, concept_text string, weight double, max_marks double,"
        " ocr_quality double, blank boolean, similarity double, evidence string",
    )
    scores = concept_scores(rows, None)
    s = scores.first()
    assert (s["status"], s["marks"], s["concept_max"], s["evidence"], s["disagreed"]) == ("MISSING", Decimal("0.00"), Decimal("3.33"), "", False)
    got = {r["answer_id"]: r for r in question_results(answers, scores).collect()}
    assert (got["blank"]["confidence"], got["blank"]["band"], got["blank"]["auto_marks"]) == (1.0, "RED", Decimal("0.00"))
    assert got["blank"]["gaps"] == "No answer provided for this question."
    # no concepts: pass agreement 1, retrieval agreement 0
    assert got["bare"]["confidence"] == 0.75

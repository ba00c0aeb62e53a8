"""Whole-cohort grading: page replies in, result tables out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from rubrica.config import DEFAULTS, PAGE_FAILED_MESSAGE, Thresholds
from rubrica.operators import pages
from rubrica.operators.results import sheet_confidence
from rubrica.plans.score import concept_scores, evaluation_runs, prepared, question_results
from rubrica.session import cut_lineage, shuffles_dropped, stored
from rubrica.sources import versions
from rubrica.sources.sinks import PER_BUCKET, bucket_of


@dataclass(frozen=True)
class Graded:
    """Result tables of one run, all keyed by sheet_id."""

    blocks: DataFrame
    annotations: DataFrame
    concept_scores: DataFrame
    evaluation_runs: DataFrame
    evaluations: DataFrame
    sheets: DataFrame


TABLES = ("blocks", "annotations", "concept_scores", "evaluation_runs", "evaluations", "sheets")


def answers_of(judged: DataFrame, sheets: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks per question, marks of those blocks, answers per sheet and question) from the blocks of `pages.judge`."""
    labelled = pages.carry_forward(pages.blocks_of(judged))
    only = pages.only_questions(sheets, questions)
    ready = pages.prepare_blocks(labelled, only).drop("underlined_words")  # they are for `reconcile_marks`; results hold none
    ready = stored(ready)  # the answers and two of the result tables are made of them
    assigned = pages.assign_blocks(sheets, questions, ready)
    answers = pages.assemble_answers(assigned).withColumn("answer_id", F.concat_ws(":", "sheet_id", "question_id"))
    return assigned.where("block_no IS NOT NULL"), pages.block_marks(pages.marks_of(judged), labelled, assigned, only), answers


def failed_sheets(replies: DataFrame) -> DataFrame:
    """Sheets with a page that could not be read: sheet_id, error_message naming the first such page."""
    return _failed(pages.page_verdicts(replies))


def _failed(verdicts: DataFrame) -> DataFrame:
    bad = verdicts.where("NOT page_ok").groupBy("sheet_id").agg(F.min("page_index").alias("page_index"))
    return bad.select("sheet_id", F.concat(F.lit(PAGE_FAILED_MESSAGE), F.col("page_index").cast("string")).alias("error_message"))


def grade_sheets(
    replies: DataFrame,
    sheets: DataFrame,
    questions: DataFrame,
    concepts: DataFrame,
    votes: DataFrame | None = None,
    t: Thresholds = DEFAULTS,
    embed=None,
) -> Graded:
    """Grade every sheet: one evaluation per sheet and question, whatever was found on the pages.

    Evaluations keep the question's text, number and maximum as they are now, so that editing the exam later changes none.
    A sheet with a page that no reply could be read from is FAILED, with a message and without evaluations.
    """
    judged = stored(pages.judge(replies))  # replies are parsed once, for failures, blocks and marks
    failed = stored(_failed(pages.verdicts_of(judged)))
    readable = sheets.join(failed, "sheet_id", "left_anti")
    blocks, marks, answers = answers_of(judged.join(failed, "sheet_id", "left_anti"), readable, questions)
    answers = stored(answers)
    # Scores feed three of the result tables; with a model behind `embed`, computing them again would call it again.
    rows = stored(prepared(answers, concepts, t, embed))
    scores = stored(concept_scores(rows, votes, t))
    results = question_results(answers, scores, t)
    texts = [c for c in ("question_text",) if c in answers.columns]
    keys = answers.select("answer_id", "sheet_id", "exam_id", "question_number", *texts)
    runs = evaluation_runs(rows, votes).join(answers.select("answer_id", "sheet_id", "exam_id", "question_id"), "answer_id")
    evaluations = results.join(keys, "answer_id")
    scores = scores.join(keys.select("answer_id", "sheet_id", "exam_id"), "answer_id")
    done = readable.select("sheet_id", "exam_id").join(sheet_confidence(readable, evaluations, t), "sheet_id")
    lost = sheets.select("sheet_id", "exam_id").join(failed, "sheet_id")
    graded = done.withColumns({"status": F.lit("DONE"), "error_message": F.lit("")}).unionByName(
        lost.withColumns({"confidence": F.lit(0.0), "band": F.lit("RED"), "status": F.lit("FAILED")})
    )
    return Graded(blocks, marks, scores, runs, evaluations, graded)


def write_graded(graded: Graded, path: str, per_bucket: int = PER_BUCKET, batch: tuple[str, int] | None = None) -> int:
    """Store a run; sheets graded before are replaced whole, in all tables at once. Returns the version.

    `batch` names the writer and its batch: a batch that is repeated changes nothing.
    """
    bucket = bucket_of("sheet_id", per_bucket)
    graded = replace(graded, sheets=cut_lineage(graded.sheets))  # read for what is regraded and again to be written
    regraded = graded.sheets.select("exam_id", "sheet_id").withColumn("sheet_bucket", bucket)
    changes = {
        name: versions.Change(getattr(graded, name).withColumn("sheet_bucket", bucket), "sheet_id", ("exam_id", "sheet_bucket"), regraded)
        for name in TABLES
    }
    with shuffles_dropped(graded.sheets.sparkSession):
        return versions.commit(graded.sheets.sparkSession, path, changes, batch)


def read_graded(spark, path: str, table: str, version: int | None = None) -> DataFrame:
    """A stored result table as of a version, the newest by default."""
    return versions.read(spark, path, table, version).drop("sheet_bucket")

"""Review queue, ownership, release and override rules over sheets and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.config import STUCK_QUEUED_MESSAGE, STUCK_RUNNING_MESSAGE
from rubrica.operators.results import sheet_totals


def filter_queue(sheets: DataFrame, band: str | None = None, status: str | None = None) -> DataFrame:
    """Optional equality filters; both reach the scan."""
    if band:
        sheets = sheets.where(F.col("band") == band)
    if status:
        sheets = sheets.where(F.col("status") == status)
    return sheets


def scope_to_teacher(df: DataFrame, exams: DataFrame, teacher_id: int) -> DataFrame:
    """Rows of exams this teacher owns."""
    return df.join(exams.where(F.col("teacher_id") == teacher_id).select("exam_id"), "exam_id", "left_semi")


def queue_rank() -> Column:
    return F.when(F.col("band") == "RED", 0).when(F.col("band") == "ORANGE", 1).otherwise(2)


def review_queue(sheets: DataFrame) -> DataFrame:
    """Worst band first, then the least certain, then the newest."""
    return sheets.withColumn("queue_rank", queue_rank()).orderBy(
        "queue_rank", "confidence", F.desc("started_at"), "sheet_id"
    )


def worst_first(concept_scores: DataFrame) -> DataFrame:
    """Missing, partial, covered; the most valuable first inside each."""
    rank = F.when(F.col("status") == "MISSING", 0).when(F.col("status") == "PARTIAL", 1).otherwise(2)
    return concept_scores.withColumn("severity", rank).orderBy("severity", F.desc("max_marks"))


# --- fixed values: default order of each entity ---------------------------------------------------
DEFAULT_ORDERS = {
    "exam": (("created_day", False), ("exam_id", True)),
    "question": (("number", True), ("question_id", True)),
    "student": (("usn", True),),
    "sheet": (("started_at", False), ("sheet_id", True)),
}


def default_order(df: DataFrame, entity: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in DEFAULT_ORDERS[entity]])


def pending_count(sheets: DataFrame, by: str = "exam_id") -> DataFrame:
    """Sheets graded but not yet approved."""
    return sheets.groupBy(by).agg(F.count_if(F.col("status") == "DONE").alias("pending"))


def sheet_facts(sheets: DataFrame, exams: DataFrame, students: DataFrame) -> DataFrame:
    """Sheet rows with their exam and student; size of each side decides the join at run time."""
    return sheets.join(
        exams.select("exam_id", "teacher_id", F.col("name").alias("exam_name"), "subject"), "exam_id"
    ).join(students.select("student_id", "usn", F.col("name").alias("student_name"), "user_id"), "student_id")


def student_results(sheets: DataFrame, ev: DataFrame, exams: DataFrame, students: DataFrame) -> DataFrame:
    """Released results: approved sheets of students who hold an account, with live totals."""
    approved = sheets.where("status = 'APPROVED'").select("sheet_id", "exam_id", "student_id")
    own = students.where("user_id IS NOT NULL").select("student_id", "user_id")
    return (
        approved.join(own, "student_id")
        .join(exams.select("exam_id", F.col("name").alias("exam_name"), "subject"), "exam_id")
        .join(sheet_totals(ev).select("sheet_id", "total_marks", "max_marks"), "sheet_id", "left")
        .select(
            "user_id",
            "sheet_id",
            "exam_name",
            "subject",
            F.coalesce("total_marks", F.lit(0)).alias("total_marks"),
            F.coalesce("max_marks", F.lit(0)).alias("max_marks"),
        )
    )


# --- fixed values: what each level of a student's result hides ------------------------------------
_DROPPED = {"concept_score": ("evidence",)}
_BLANKED = {"block": ("crop_url", "raw_text"), "page": ("page_url",)}


def redact(df: DataFrame, level: str) -> DataFrame:
    """Student view of one level of a result."""
    df = df.drop(*_DROPPED.get(level, ()))
    return df.withColumns({c: F.lit("") for c in _BLANKED.get(level, ()) if c in df.columns})


def sweep_stuck(sheets: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Running sheets fail; queued ones idle since before the cut-off fail too."""
    idle = F.coalesce("last_run_started_at", "started_at") < now - F.make_dt_interval(mins=F.lit(minutes))
    return sheets.where((F.col("status") == "RUNNING") | ((F.col("status") == "QUEUED") & idle)).select(
        "sheet_id",
        F.col("status").alias("old_status"),
        F.lit("FAILED").alias("status"),
        F.when(F.col("status") == "RUNNING", STUCK_RUNNING_MESSAGE)
        .otherwise(STUCK_QUEUED_MESSAGE.format(minutes=minutes))
        .alias("error_message"),
    )


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Newest row of each key as a partial aggregate, so one hot key never sorts in one task."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def check_overrides(ev: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with the evaluation's maximum and the reason a request is refused, null when it stands."""
    bad = (F.col("has_marks")) & ((F.col("new_marks") < 0) | (F.col("new_marks") > F.col("max_marks")))
    known = ev.select("evaluation_id", "max_marks", F.lit(True).alias("_known"))
    reason = F.when(F.col("_known").isNull(), F.lit("no such evaluation")).when(bad, F.lit("override_marks out of range"))
    return requests.join(known, "evaluation_id", "left").withColumn("reject_reason", reason).drop("_known")


def apply_overrides(ev: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated evaluations, rejected requests).

    `requests`: evaluation_id, seq, has_marks, new_marks, has_comment, new_comment. Each field keeps the value of the
    latest valid request that carried it; a carried null mark clears the override and a null comment becomes ''.
    """
    checked = check_overrides(ev, requests)
    good = checked.where("reject_reason IS NULL")
    last = good.groupBy("evaluation_id").agg(
        F.max_by(F.struct("new_marks"), F.when(F.col("has_marks"), F.col("seq"))).alias("m"),
        F.max_by(
            F.struct(F.coalesce("new_comment", F.lit("")).alias("c")), F.when(F.col("has_comment"), F.col("seq"))
        ).alias("c"),
        F.bool_or("has_marks").alias("touch_m"),
        F.bool_or("has_comment").alias("touch_c"),
    )
    updated = (
        ev.join(last, "evaluation_id", "left")
        .withColumn("override_marks", F.when(F.col("touch_m"), F.col("m.new_marks")).otherwise(F.col("override_marks")))
        .withColumn("override_comment", F.when(F.col("touch_c"), F.col("c.c")).otherwise(F.col("override_comment")))
        .drop("m", "c", "touch_m", "touch_c")
    )
    return updated, checked.where("reject_reason IS NOT NULL")

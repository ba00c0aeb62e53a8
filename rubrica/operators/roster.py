"""Roster validation and import, account claims, enrolment checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rubrica.config import EMAIL_PATTERN, USN_PATTERN
from rubrica.functions.text import strip


def first_valid(rows: DataFrame, key: list[str], ok: str, order: str, out: str = "first_row") -> DataFrame:
    """Append the lowest `order` among a key's rows that pass `ok`.

    Aggregated first and joined back, so a key repeated across much of the table is reduced on the map side and its
    rows stay spread out.
    """
    firsts = rows.where(F.col(ok)).groupBy(*key).agg(F.min(order).alias(out))
    return rows.join(firsts, key, "left")


def validate_roster(rows: DataFrame) -> DataFrame:
    """Append trimmed fields and `reason`, null for a row that may be imported.

    `rows`: exam_id, row_no, usn, name, email. A row that fails does not reserve its USN, so a duplicate is a row after
    the first one that passed every other check.
    """
    clean = rows.withColumns(
        {
            "usn": F.upper(strip(F.coalesce("usn", F.lit("")))),
            "name": strip(F.coalesce("name", F.lit(""))),
            "email": strip(F.coalesce("email", F.lit(""))),
        }
    )
    bad_usn = ~F.col("usn").rlike(USN_PATTERN)
    bad_email = (F.col("email") != "") & ~F.col("email").rlike(EMAIL_PATTERN)
    clean = clean.withColumn("_ok", ~bad_usn & (F.col("name") != "") & ~bad_email)
    seen = first_valid(clean, ["exam_id", "usn"], "_ok", "row_no")
    usn = F.col("usn")
    return seen.withColumn(
        "reason",
        F.when(usn == "", "USN is missing")
        .when(bad_usn, F.concat(usn, F.lit(" looks malformed")))
        .when(F.col("row_no") > F.col("first_row"), F.concat(usn, F.lit(" is a duplicate in this file")))
        .when(F.col("name") == "", F.concat(usn, F.lit(": name is missing")))
        .when(bad_email, F.concat(usn, F.lit(": email is not valid"))),
    ).drop("_ok", "first_row")


def import_roster(rows: DataFrame, students: DataFrame, enrollments: DataFrame):
    """(outcomes, new_students, new_enrollments) of roster files, one file per exam.

    An existing student is linked and keeps the stored name and e-mail; an unknown one is created from the first row
    that names it. `students`: student_id, usn, ...; `enrollments`: exam_id, student_id.
    """
    checked = validate_roster(rows).join(students.select("usn", "student_id"), "usn", "left")
    held = enrollments.select("exam_id", "student_id").withColumn("_held", F.lit(True))
    outcomes = (
        checked.join(held, ["exam_id", "student_id"], "left")
        .withColumn(
            "reason",
            F.coalesce("reason", F.when(F.col("_held"), F.concat("usn", F.lit(" is already enrolled")))),
        )
        .drop("_held")
        .withColumn("outcome", F.when(F.col("reason").isNull(), "created").otherwise("skipped"))
    )
    created = outcomes.where("outcome = 'created'")
    new_students = (
        created.where("student_id IS NULL")
        .groupBy("usn")
        .agg(F.min_by(F.struct("name", "email"), F.struct("exam_id", "row_no")).alias("p"))
        .select("usn", "p.name", "p.email")
    )
    return outcomes, new_students, created.select("exam_id", "usn", "student_id")


def import_report(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts per file, error rows in row order). Errors stay rows: a file may hold any number of them."""
    counts = outcomes.groupBy("exam_id").agg(
        F.count_if(F.col("outcome") == "created").alias("created"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
    )
    errors = (
        outcomes.where("reason IS NOT NULL")
        .select("exam_id", "row_no", F.col("reason").alias("message"))
        .orderBy("exam_id", "row_no")
    )
    return counts, errors


def enrolled(uploads: DataFrame, enrollments: DataFrame) -> DataFrame:
    return uploads.join(enrollments, ["exam_id", "student_id"], "left_semi")


def not_enrolled(uploads: DataFrame, enrollments: DataFrame) -> DataFrame:
    return uploads.join(enrollments, ["exam_id", "student_id"], "left_anti").withColumn(
        "reason", F.lit("This student is not enrolled in this exam.")
    )


def claim_students(regs: DataFrame, students: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, student changes) of account registrations taken in `reg_id` order.

    `regs`: reg_id, role, usn, full_name, email, new_user_id. Action is create, link, none (teacher) or reject.
    """
    usn = F.upper(strip(F.coalesce("usn", F.lit(""))))
    clean = regs.withColumn("usn", usn)
    is_student = F.col("role") == "STUDENT"
    early = (
        F.when(is_student & (F.col("usn") == ""), "This field is required for students.")
        .when(is_student & ~F.col("usn").rlike(USN_PATTERN), "USN looks malformed.")
        .when(~is_student & (F.col("usn") != ""), "USN must not be set for teacher accounts.")
    )
    clean = clean.withColumn("reason", early).withColumn("_ok", is_student & F.col("reason").isNull())
    known = students.select(
        "usn", "student_id", F.col("user_id").alias("_user"), F.col("name").alias("_name"), F.col("email").alias("_email")
    )
    judged = first_valid(clean, ["usn"], "_ok", "reg_id").join(known, "usn", "left")
    taken = F.col("_ok") & (F.col("_user").isNotNull() | (F.col("reg_id") > F.col("first_row")))
    outcomes = judged.withColumn(
        "reason", F.coalesce("reason", F.when(taken, "A student with this USN is already registered."))
    ).withColumn(
        "action",
        F.when(F.col("reason").isNotNull(), "reject")
        .when(~is_student, "none")
        .when(F.col("student_id").isNull(), "create")
        .otherwise("link"),
    )
    changes = outcomes.where("action IN ('create', 'link')").select(
        "usn",
        F.coalesce("_name", "full_name").alias("name"),
        F.coalesce(F.nullif("_email", F.lit("")), "email").alias("email"),
        F.col("new_user_id").alias("user_id"),
        "action",
    )
    return outcomes.select("reg_id", "role", "usn", "action", "reason"), changes

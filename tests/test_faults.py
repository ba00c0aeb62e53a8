"""Cases that no registered query holds."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rubrica.functions.vectors import hash_embed
from rubrica.operators import queue
from rubrica.operators.audit import diff_words
from rubrica.operators.retrieval import similarity_join
from rubrica.plans.grade import failed_sheets
from rubrica.plans.score import retrieve
from rubrica.session import shared_dir
from rubrica.sources import sinks
from rubrica.sources.tables import extract_test_cases, read_pairs, roster_rows
from rubrica.streaming.states import replay_states


def test_long_vectors_are_compared_whole(spark):
    same, other = [1.0] * 16 + [0.0] * 48, [1.0] * 16 + [3.0] * 48
    q = spark.createDataFrame([(1, same)], "k int, q_vec array<double>")
    c = spark.createDataFrame([(1, other), (1, same)], "k int, c_vec array<double>")
    raw = sorted(r["raw"] for r in similarity_join(q, c, ["k"]).collect())
    assert raw[1] == pytest.approx(1.0) and raw[0] == pytest.approx(16 / 4 / (16 + 9 * 48) ** 0.5)
    short = spark.createDataFrame([(1, [1.0])], "k int, c_vec array<double>")
    with pytest.raises(PySparkException, match="unequal length"):
        similarity_join(q, short, ["k"]).collect()


def test_callers_embedder_of_any_length(spark):
    embed = lambda df, col: hash_embed(df, col, 64)
    answers = spark.createDataFrame([(1, 1, "Water boils at high heat.")], "answer_id int, question_id int, text string")
    concepts = embed(spark.createDataFrame([(1, 7, "Water boils at high heat.", 1.0)], "question_id int, concept_id int, text string, weight double"), "text")
    row = retrieve(answers, concepts, embed=embed).first()
    assert row["concept_id"] == 7 and len(concepts.first()["embedding"]) == 64


def test_roster_of_forty_columns(spark):
    head = ",".join([f"c{i}" for i in range(33)] + ["USN", "Name", "Email"] + [f"d{i}" for i in range(4)])
    line = ",".join(["x"] * 33 + ["1AB", '"Doe, ""J"" "', " a@b.c "] + ["y"] * 4)
    files = spark.createDataFrame([("f", f"{head}\n{line}\n")], "file string, value string")
    assert [tuple(r) for r in roster_rows(files).collect()] == [("f", 1, "1AB", 'Doe, "J"', "a@b.c")]


def test_pairs_and_cases_are_read_whole(spark):
    path = shared_dir(spark, "pairs")
    rows = spark.range(400).select(F.concat_ws("\t", *[F.lit("h")] * 7, F.concat(F.lit("a"), "id"), F.lit("b"), F.lit("2.5")).alias("value"))
    rows.coalesce(1).write.text(path)
    assert read_pairs(spark, path, heading=False).count() == 400
    long = "word " * 1000
    doc = f"x\n## Test t\n\n### Question\n\n```text\n{long}\n```\n\n### Model Answer\n\n```text\n{long}\n```\n"
    case = extract_test_cases(spark.createDataFrame([("d", doc)], "doc string, value string")).first()
    assert len(case["question"]) == len(case["model_answer"]) == len(long.strip())


def test_regrading_to_nothing_leaves_no_rows(spark):
    path = shared_dir(spark, "results")
    rows = spark.createDataFrame([(1, 1, "a"), (1, 900, "b"), (2, 2, "c")], "exam_id int, sheet_id long, v string")
    sinks.write_results(rows, path, per_bucket=100)
    sinks.write_results(rows.limit(0), path, rows.where("sheet_id = 900").select("exam_id", "sheet_id"), per_bucket=100)
    assert sorted(r["sheet_id"] for r in spark.read.parquet(path).collect()) == [1, 2]
    concepts = spark.createDataFrame([(1, "a"), (2, "b")], "question_id long, text string")
    path = shared_dir(spark, "concepts")
    sinks.write_concepts(concepts, path)
    sinks.write_concepts(concepts.limit(0), path, concepts.where("question_id = 2").select("question_id"))
    assert [r["question_id"] for r in spark.read.parquet(path).collect()] == [1]


def test_a_table_that_cannot_be_read_is_not_overwritten(spark):
    path = shared_dir(spark, "broken")
    spark.createDataFrame([("x",)], "value string").write.text(path)
    rows = spark.createDataFrame([(1, 1, "a")], "exam_id int, sheet_id long, v string")
    with pytest.raises(Exception, match="not a Parquet|FAILED_READ_FILE"):
        sinks.write_results(rows, path)


def test_unknown_commands_change_nothing(spark):
    log = ["run", "finish", "pause", None, "approve"]
    commands = spark.createDataFrame([(1, i, c) for i, c in enumerate(log)], "sheet_id long, seq long, command string")
    got = replay_states(commands).orderBy("seq").collect()
    assert [r["status"] for r in got] == ["RUNNING", "DONE", "DONE", "DONE", "APPROVED"]
    assert [r["accepted"] for r in got] == [True, True, False, False, True]


def test_overrides_of_unknown_evaluations_are_rejected(spark):
    ev = spark.createDataFrame([(1, 5.0, 3.0, None, "")], "evaluation_id long, max_marks double, auto_marks double, override_marks double, override_comment string")
    asked = spark.createDataFrame([(1, 1, True, 4.0, False, None), (9, 2, True, 1.0, False, None)], "evaluation_id long, seq long, has_marks boolean, new_marks double, has_comment boolean, new_comment string")
    _, rejected = queue.apply_overrides(ev, asked)
    assert [(r["evaluation_id"], r["reject_reason"]) for r in rejected.collect()] == [(9, "no such evaluation")]


def test_sheets_with_an_unreadable_page_fail(spark):
    replies = spark.createDataFrame(
        [(1, 0, 800, 1000, "only prose"), (2, 0, 800, 1000, '{"blocks": []}'), (1, 1, 800, 1000, "more prose")],
        "sheet_id long, page_index long, page_w long, page_h long, reply string",
    )
    assert [(r[0], r[1][-6:]) for r in failed_sheets(replies).collect()] == [(1, "page 0")]


def test_difference_of_long_texts():
    old = " ".join(f"w{i}" for i in range(3000))
    new = old.replace("w1500 ", "x y ").replace("w7 ", "W7, ")
    assert diff_words(old, new) == [
        ("same", " ".join(["W7," if i == 7 else f"w{i}" for i in range(1500)])), ("removed", "w1500"), ("added", "x y"),
        ("same", " ".join(f"w{i}" for i in range(1501, 3000))),
    ]
    assert diff_words("a b", "b a") == [("removed", "a"), ("same", "b"), ("added", "a")]
    assert diff_words("", "a") == [("added", "a")] and diff_words("a", "") == [("removed", "a")]

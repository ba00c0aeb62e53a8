"""Page replies: what their plans may not do."""

from rubrica.operators import pages
from workload import catalog  # noqa: F401
from workload.registry import Tables

REPLY = '{"blocks": [{"bbox": {"x": 1, "y": 2, "w": 300, "h": 400}, "content_type": "text", "confidence": 0.5, "annotations": []}]}'


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_do_not_parse_again(spark):
    replies = spark.range(1).selectExpr(
        "id AS sheet_id", "0L AS page_index", "800L AS page_w", "1000L AS page_h", f"concat('{REPLY}', id) AS reply"
    )
    for out in (pages.page_blocks(replies), pages.page_marks(replies), pages.page_rejects(replies)):
        assert not [line for line in plan(out).splitlines() if "Filter" in line and "from_json" in line]
    assert [r["block_no"] for r in pages.page_blocks(replies).collect()] == [0]


def test_words_of_a_page_are_not_exploded(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in plan(t("v_page_text"))
    rows = t("v_word").groupBy("doc_id", "block_id").count().selectExpr("doc_id", "block_id % 10000 AS b", "count AS words")
    cut = t("v_page_text").select("doc_id", "b", "words")
    assert rows.exceptAll(cut).isEmpty() and cut.exceptAll(rows).isEmpty() and not cut.isEmpty()


def test_grading_reads_stored_replies(spark, monkeypatch):
    from workload import jobs

    seen = []
    monkeypatch.setattr(jobs.grade, "grade_sheets", lambda replies, *rest, **kw: seen.append(replies))
    jobs._graded(Tables(spark, "/root/testdata/sf0.001"))
    assert "ExistingRDD" in plan(seen[0]) and "documents" not in plan(seen[0])


def test_large_tables_are_asked_in_a_bounded_number_of_tasks(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from rubrica.plans import transcribe
    from workload.stand_ins import late_model

    monkeypatch.setattr(transcribe, "TASKS_A_CORE", 1, raising=False)
    pages_ = spark.range(1, 101).selectExpr("id AS sheet_id", "0L AS page_index", "9L AS page_w", "9L AS page_h", "CAST(CAST(id AS string) AS binary) AS content")
    got = {r["sheet_id"]: r["attempts"] for r in transcribe.transcribe_pages(pages_, late_model, str(tmp_path), per_task=1).collect()}
    assert got == {i: 1 if i % 10 == 0 else min(3, 1 + i % 4) for i in range(1, 101)}
    assert len(list(Path(tmp_path, "raw", "attempt=1").glob("*.parquet"))) <= spark.sparkContext.defaultParallelism


def test_joined_text_blocks_keep_the_underlined_words_of_all_parts(spark):
    schema = "sheet_id long, page_index long, block_no long, key string, question_number string, x double, y double, w double, h double, " \
        "page_w long, page_h long, content_type string, raw_text string, reconstructed_text string, confidence double, underlined_words array<string>"
    rows = [
        (1, 0, 0, "1a", None, 0.0, 50.0, 800.0, 10.0, 800, 1000, "TEXT", "b", "b", 0.5, ["lower", "word"]),
        (1, 0, 1, "1a", "1a", 0.0, 10.0, 800.0, 10.0, 800, 1000, "TEXT", "a", "a", 0.7, ["upper"]),
        (1, 0, 2, "1a", "1a", 9.0, 99.0, 80.0, 10.0, 800, 1000, "DIAGRAM", "", "", 0.7, ["own"]),
        (1, 0, 3, "2", "2", 0.0, 90.0, 800.0, 10.0, 800, 1000, "TEXT", "c", "c", 0.7, []),
    ]
    out = {r["block_no"]: r for r in pages.merge_text_blocks(spark.createDataFrame(rows, schema)).collect()}
    assert {n: (r["question_number"], r["underlined_words"]) for n, r in out.items()} == {
        1: ("1a", ["upper", "lower", "word"]), 2: ("1a", ["own"]), 3: ("2", []),
    }
    assert (out[1]["y"], out[1]["h"], out[1]["reconstructed_text"]) == (10.0, 80.0, "a b")


def test_grading_parses_replies_once_and_stores_columns(spark, monkeypatch):
    from workload import jobs

    calls, judge = [], pages.judge
    monkeypatch.setattr(pages, "judge", lambda replies: calls.append(1) or judge(replies))
    graded = jobs._graded(Tables(spark, "/root/testdata/sf0.001"))
    assert len(calls) == 1
    for table in ("blocks", "annotations", "concept_scores", "evaluations", "sheets"):
        text = plan(getattr(graded, table))
        assert "ExistingRDD" not in text and "FileScan parquet" in text, table
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # as it was

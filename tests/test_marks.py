"""Marks: expressions of a line are computed once a row, however many conditions name them."""

import math
import random

from rubrica.functions.geometry import with_geometry
from rubrica.operators import marks
from rubrica.operators.spatial import endpoint_pairs

LINE = "block_id bigint, line_no bigint, kind string, x1 double, y1 double, x2 double, y2 double, local double, above double, below double, tip double, tail double, confidence double"


def times(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().upper().count(what)


def test_scores_are_computed_once_a_line(spark):
    lines = spark.createDataFrame([(1, 1, "STRIKE", 0.0, 0.0, 30.0, 1.0, 40.0, 0.9, 0.8, 0.1, 0.2, 0.5)], LINE)
    out = marks.score_marks(with_geometry(lines)).select("block_id", "line_no", "kind", "confidence")
    assert [tuple(r) for r in out.collect()] == [(1, 1, "STRIKE", 0.7752)]
    assert times(out, "ATAN2") == times(out, "HYPOT") == 1


def test_ruling_reads_lines_twice(spark):
    rows = [(1, 1, "STRIKE", 0.0, 2.0, 90.0, 2.0), (1, 2, "UNDERLINE", 0.0, 50.0, 20.0, 50.0), (1, 3, "ARROW", 5.0, 0.0, 5.0, 95.0), (1, 4, "ARROW", 9.0, 0.0, 9.0, 30.0)]
    lines = spark.createDataFrame([(*r, 0.0, 0.0, 0.0, 0.0, 0.0, 0.9) for r in rows], LINE)
    blocks = spark.createDataFrame([(1, 100.0, 100.0)], "block_id bigint, block_w double, block_h double")
    out = marks.flag_ruled(lines, blocks)
    got = {r["line_no"]: (r["on_ruling"], r["confidence"]) for r in out.collect()}
    assert got == {1: (True, 0.69), 2: (False, 0.9), 3: (True, 0.69), 4: (False, 0.9)}
    assert times(out, "HYPOT") <= 2


def test_endpoint_pairs_meet_once_in_half_the_cells(spark):
    rng = random.Random(5)
    lines = [(1, i, *[rng.uniform(-60, 60) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(lines, "block_id bigint, line_no bigint, x1 double, y1 double, x2 double, y2 double")
    out = endpoint_pairs(df, "block_id", "line_no", 10.0)
    near = lambda p, q: any(math.dist(p[i : i + 2], q[j : j + 2]) <= 10 for i in (2, 4) for j in (2, 4))
    want = [(1, p[1], q[1]) for p in lines for q in lines if p[1] < q[1] and near(p, q)]
    assert sorted(map(tuple, out.collect())) == want
    assert times(out, "EXPLODE") == 3  # both sides' ends, and cells once where it was twice


MARK = "block_id bigint, mark_id bigint, kind string, intent string, confidence double, resolved_by string, x double, y double, w double, h double"


def test_marks_are_reconciled_in_one_shuffle_without_joins(spark, monkeypatch):
    box = (0.0, 20.0, 30.0, 4.0)
    vlm = [
        (1, 1, "STRIKE", "CORRECTION", 0.5, "VLM", *box), (1, 2, "UNDERLINE", "EMPHASIS", 0.5, "VLM", 100.0, 20.0, 30.0, 4.0),
        (1, 3, "ARROW", "INSERTION", 0.5, "VLM", *box), (2, 1, "STRIKE", "CORRECTION", 0.5, "VLM", *box),
        (None, 1, "UNDERLINE", "EMPHASIS", 0.5, "VLM", *box), (1, None, "STRIKE", "CORRECTION", 0.5, "VLM", *box),
    ]
    cv = [
        (1, 11, "UNDERLINE", "EMPHASIS", 0.9, "CV", 1.0, 20.0, 30.0, 4.0), (1, 12, "UNDERLINE", "EMPHASIS", 0.2, "CV", 101.0, 20.0, 30.0, 4.0),
        (1, 13, "UNDERLINE", "EMPHASIS", 0.2, "CV", 300.0, 20.0, 30.0, 4.0), (2, 11, "UNDERLINE", "EMPHASIS", 0.9, "CV", *box),
        (None, 11, "UNDERLINE", "EMPHASIS", 0.9, "CV", *box), (1, None, "UNDERLINE", "EMPHASIS", 0.2, "CV", 101.0, 20.0, 30.0, 4.0),
    ]
    words = [(1, 2, "Bee!", 118.0, 4.0, 12.0, 14.0), (1, 1, "Hon,", 100.0, 4.0, 16.0, 14.0), (1, 3, "far", 300.0, 4.0, 20.0, 14.0)]
    frames = (
        spark.createDataFrame(vlm, MARK), spark.createDataFrame(cv, MARK),
        spark.createDataFrame(words, "block_id bigint, word_no bigint, text string, x double, y double, w double, h double"),
        spark.createDataFrame([(1, "honbee"), (1, "?"), (2, "far")], "block_id bigint, text string"),
        spark.createDataFrame([(1, "plain"), (2, r"\frac{a}")], "block_id bigint, raw_text string"),
    )
    monkeypatch.setattr(marks, "PAIRS_HELD", 1)
    out = marks.reconcile_marks(*frames)
    got = sorted(((r["block_id"] or 0, r["mark_id"] or 0, r["kind"], r["intent"], r["resolved_by"]) for r in out.collect()))
    # mark 1 is flipped and then replaced by 11, 2 by 12, whose two words together are one the model named
    assert got == [
        (0, 1, "UNDERLINE", "EMPHASIS", "VLM"), (1, 0, "STRIKE", "CORRECTION", "VLM"), (1, 3, "ARROW", "INSERTION", "VLM"),
        (1, 11, "UNDERLINE", "EMPHASIS", "CV"), (1, 12, "UNDERLINE", "EMPHASIS", "CV"), (2, 1, "STRIKE", "CORRECTION", "VLM"),
    ]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 + plan.count("AQEShuffleRead")

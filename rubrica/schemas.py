"""Declared schemas of the stored tables, as DDL that `spark.read.schema` and `createDataFrame` take."""

from __future__ import annotations

_BOX = "struct<x:double,y:double,w:double,h:double>"

TABLES = {
    "exam": "exam_id bigint, teacher_id bigint, name string, subject string, exam_date date, total_marks int, created_at timestamp",
    "question": (
        "question_id bigint, exam_id bigint, number string, text string, max_marks decimal(5,2), model_answer string,"
        " model_answer_hash string, concepts_indexed_at timestamp"
    ),
    "concept": "concept_id bigint, question_id bigint, text string, weight double, ord int, embedding array<float>",
    "student": "student_id bigint, usn string, name string, email string, user_id bigint, created_at timestamp",
    "enrollment": "exam_id bigint, student_id bigint, created_at timestamp",
    "user": "user_id bigint, role string, full_name string, department string",
    "answer_sheet": (
        "sheet_id bigint, exam_id bigint, student_id bigint, status string, stage string, page_count int, confidence double,"
        " band string, error_message string, started_at timestamp, last_run_started_at timestamp, approved_at timestamp"
    ),
    "sheet_page": "sheet_id bigint, page_index int, path string, length bigint, content_type string",
    "evaluation": (
        "evaluation_id bigint, sheet_id bigint, question_id bigint, question_number string, question_text string,"
        " max_marks decimal(6,2), auto_marks decimal(6,2), override_marks decimal(6,2), override_comment string,"
        " confidence double, band string, strengths string, gaps string, suggestions string"
    ),
    "answer_block": (
        "block_id bigint, evaluation_id bigint, image_width int, image_height int, quality_score double, content_type string,"
        " ocr_engine string, raw_text string, reconstructed_text string"
    ),
    "annotation": f"block_id bigint, mark_id bigint, kind string, intent string, bbox {_BOX}, confidence double, resolved_by string",
    "concept_score": (
        "evaluation_id bigint, concept_id bigint, concept_text string, status string, similarity double, marks decimal(6,2),"
        " max_marks decimal(6,2), evidence string, disagreed boolean"
    ),
    "evaluation_run": "evaluation_id bigint, concept_id bigint, pass_no int, raw_response string, latency_ms double",
    "page_reply": "sheet_id bigint, page_index int, page_w int, page_h int, reply string",
    "word": "block_id bigint, word_no bigint, text string, x double, y double, w double, h double",
    "line": "block_id bigint, line_no bigint, x1 double, y1 double, x2 double, y2 double",
    "command": "sheet_id bigint, seq bigint, ts timestamp, command string",
}

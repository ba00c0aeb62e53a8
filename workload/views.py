"""Fixture views: the tables of a grading service, derived from whole driver tables.

Group keys are either aggregated with map-side partials or bounded by construction: a sheet is one document, a block
is at most sixty consecutive words of it, a question has at most eight concepts.
"""

from workload.registry import view

view(
    "v_exam",
    """
SELECT CAST(n_nationkey AS BIGINT) AS exam_id, CAST(n_regionkey AS BIGINT) AS teacher_id, n_name AS name,
       r_name AS subject, CAST(20 + n_nationkey AS BIGINT) AS total_marks,
       CAST(CAST('2024-01-01' AS DATE) + n_nationkey * 17 % 100 AS VARCHAR(10)) AS exam_date,
       CAST(n_nationkey * 31 % 97 AS BIGINT) AS created_day
FROM nation JOIN region ON n_regionkey = r_regionkey
""",
)

view(
    "v_student",
    """
SELECT c_custkey AS student_id, upper(concat('1BY', CAST(100000 + c_custkey AS VARCHAR(12)))) AS usn, c_name AS name,
       concat('s', CAST(c_custkey AS VARCHAR(12)), '@example.org') AS email,
       CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey + 500000 END AS user_id
FROM customer
""",
)

view(
    "v_enrollment",
    """
SELECT c_custkey % 25 AS exam_id, c_custkey AS student_id FROM customer WHERE c_mktsegment <> 'MACHINERY'
""",
)

view(
    "v_sheet_base",
    """
SELECT o_orderkey AS sheet_id, o_custkey AS student_id, o_custkey % 25 AS exam_id,
       CASE WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_orderstatus = 'P' THEN 'APPROVED'
            WHEN o_orderpriority = '5-LOW' THEN 'FAILED' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'RUNNING'
            ELSE 'QUEUED' END AS status,
       CAST((o_orderkey * 37 + 11) % 1000 AS DOUBLE) / 1000 AS raw_confidence,
       o_orderdate AS started_at, o_totalprice
FROM orders
""",
)

view(
    "v_sheet",
    """
SELECT sheet_id, student_id, exam_id, status,
       CASE WHEN status IN ('DONE', 'APPROVED') THEN raw_confidence ELSE CAST(0 AS DOUBLE) END AS confidence,
       CASE WHEN status NOT IN ('DONE', 'APPROVED') OR raw_confidence < 0.65 THEN 'RED'
            WHEN raw_confidence < 0.80 THEN 'ORANGE' ELSE 'GREEN' END AS band,
       CASE WHEN status IN ('DONE', 'APPROVED') THEN 'done' WHEN status = 'QUEUED' THEN 'queued'
            WHEN o_totalprice < 150000 THEN 'ocr' WHEN o_totalprice < 300000 THEN 'scoring'
            ELSE 'adjudication' END AS stage,
       started_at,
       CASE WHEN status <> 'QUEUED' OR o_totalprice > 250000 THEN started_at + INTERVAL '5' MINUTE END
           AS last_run_started_at
FROM v_sheet_base
""",
)

view(
    "v_evaluation",
    """
SELECT l_orderkey AS sheet_id, CAST(l_linenumber AS BIGINT) AS question_id,
       CAST(l_quantity / 10 AS DECIMAL(6,2)) AS auto_marks, CAST(10 AS DECIMAL(6,2)) AS max_marks,
       CASE WHEN l_returnflag = 'A' THEN CAST(l_discount * 100 AS DECIMAL(6,2)) END AS override_marks,
       CAST(1 - 5 * l_tax AS DECIMAL(6,4)) AS confidence
FROM lineitem
""",
)

view(
    "v_concept_score",
    """
SELECT l_orderkey AS sheet_id, CAST(l_linenumber AS BIGINT) AS question_id, l_partkey AS concept_id,
       concat(p_name, ' ', p_brand) AS concept_text,
       CASE l_returnflag WHEN 'A' THEN 'COVERED' WHEN 'R' THEN 'PARTIAL' ELSE 'MISSING' END AS status,
       CAST(CASE l_returnflag WHEN 'A' THEN l_quantity / 10 WHEN 'R' THEN l_quantity / 20 ELSE 0 END AS DECIMAL(6,2))
           AS marks,
       CAST(l_quantity / 10 AS DECIMAL(6,2)) AS max_marks
FROM lineitem JOIN part ON l_partkey = p_partkey
""",
)

view(
    "v_annotation",
    """
SELECT l_orderkey AS sheet_id, CAST(l_linenumber AS BIGINT) AS question_id,
       CASE l_linenumber % 4 WHEN 0 THEN 'STRIKE' WHEN 1 THEN 'UNDERLINE' WHEN 2 THEN 'ARROW' ELSE 'MARGIN' END AS kind,
       CASE l_linestatus WHEN 'F' THEN 'VLM' ELSE 'CV' END AS resolved_by
FROM lineitem
""",
)

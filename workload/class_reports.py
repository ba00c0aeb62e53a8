"""Marks, totals, class summaries, queues and release rules."""

from pyspark.sql import functions as F

from rubrica.operators import queue, results
from rubrica.plans import summary
from workload.registry import query, r, view

LIVE = "status <> 'FAILED'"

view(
    "s_totals",
    """
SELECT sheet_id, sum(coalesce(override_marks, auto_marks)) AS total, sum(max_marks) AS available, count(*) AS n
FROM v_evaluation GROUP BY sheet_id
""",
)
view(
    "s_live",
    """
SELECT s.sheet_id, s.exam_id, s.status, s.band, s.confidence, coalesce(t.total, 0) AS total
FROM v_sheet s LEFT JOIN s_totals t ON s.sheet_id = t.sheet_id WHERE s.status <> 'FAILED'
""",
)
view(
    "s_miss",
    """
SELECT l.exam_id, c.concept_text, count(*) FILTER (WHERE c.status = 'MISSING') AS missing,
       count(*) FILTER (WHERE c.status = 'PARTIAL') AS partial, count(*) FILTER (WHERE c.status = 'COVERED') AS covered
FROM v_concept_score c JOIN s_live l ON c.sheet_id = l.sheet_id GROUP BY l.exam_id, c.concept_text
""",
)
view(
    "s_rate",
    f"""
SELECT l.exam_id, {r("avg(CASE WHEN a.resolved_by = 'VLM' THEN 1.0::DOUBLE ELSE 0 END)")} AS vlm_escalation_rate
FROM v_annotation a JOIN s_live l ON a.sheet_id = l.sheet_id GROUP BY l.exam_id
""",
)
view(
    "s_top",
    """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exam_id ORDER BY missing DESC, concept_text) AS rank
               FROM s_miss) WHERE rank <= 8
""",
)


@query(
    "effective_marks",
    """SELECT sheet_id, question_id, auto_marks::DOUBLE AS auto_marks,
       CASE WHEN override_marks IS NULL THEN auto_marks ELSE override_marks END::DOUBLE AS effective_marks
       FROM v_evaluation""",
)
def _(t):
    return results.with_effective_marks(t("v_evaluation")).select(
        "sheet_id", "question_id", "auto_marks", "effective_marks"
    )


@query(
    "question_marks",
    """SELECT sheet_id, question_id, sum(marks)::DOUBLE AS auto_marks FROM v_concept_score
       GROUP BY sheet_id, question_id""",
)
def _(t):
    return results.question_marks(t("v_concept_score"))


@query(
    "sheet_totals",
    """SELECT sheet_id, total::DOUBLE AS total_marks, available::DOUBLE AS max_marks, n AS questions FROM s_totals""",
)
def _(t):
    return results.sheet_totals(t("v_evaluation"))


@query(
    "sheet_confidence",
    f"""WITH m AS (SELECT s.sheet_id, coalesce(sum(e.confidence)::DOUBLE / count(e.confidence), 0) AS c
               FROM v_sheet s LEFT JOIN v_evaluation e ON s.sheet_id = e.sheet_id GROUP BY s.sheet_id)
       SELECT sheet_id, {r("c", 6)} AS confidence,
              CASE WHEN c >= 0.8 THEN 'GREEN' WHEN c >= 0.65 THEN 'ORANGE' ELSE 'RED' END AS band FROM m""",
)
def _(t):
    df = results.sheet_confidence(t("v_sheet"), t("v_evaluation"))
    return df.withColumn("confidence", F.round("confidence", 6))


@query(
    "band_counts",
    """SELECT exam_id, count(*) FILTER (WHERE band = 'GREEN') AS green, count(*) FILTER (WHERE band = 'ORANGE') AS orange,
       count(*) FILTER (WHERE band = 'RED') AS red FROM s_live GROUP BY exam_id""",
)
def _(t):
    return results.band_counts(results.exclude_failed(t("v_sheet")))


@query(
    "exclude_failed",
    """SELECT exam_id, count(*) AS n FROM v_sheet WHERE NOT (status = 'FAILED') GROUP BY exam_id""",
)
def _(t):
    return results.exclude_failed(t("v_sheet")).groupBy("exam_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "mark_distribution",
    """WITH b(bucket, lo, hi) AS (VALUES ('0-4', 0, 5), ('5-8', 5, 9), ('9-12', 9, 13), ('13-16', 13, 17), ('17-20', 17, 21)),
       e AS (SELECT DISTINCT exam_id FROM s_live)
       SELECT e.exam_id, b.bucket, count(l.sheet_id) AS count
       FROM e CROSS JOIN b LEFT JOIN s_live l ON l.exam_id = e.exam_id AND l.total >= b.lo AND l.total < b.hi
       GROUP BY e.exam_id, b.bucket""",
)
def _(t):
    return results.mark_distribution(summary.exam_marks(t("v_sheet"), t("v_evaluation")))


@query("concept_miss_rate", "SELECT exam_id, concept_text, missing, partial, covered FROM s_miss")
def _(t):
    return summary.exam_misses(t("v_sheet"), t("v_concept_score"))


@query("most_missed", "SELECT exam_id, concept_text, missing, partial, covered, rank FROM s_top")
def _(t):
    return results.most_missed(summary.exam_misses(t("v_sheet"), t("v_concept_score")))


@query("escalation_rate", "SELECT exam_id, vlm_escalation_rate FROM s_rate")
def _(t):
    return summary.exam_escalation(t("v_sheet"), t("v_annotation"))


@query(
    "escalation_by_kind",
    f"""SELECT kind, count(*) AS annotations,
        {r("avg(CASE WHEN resolved_by = 'VLM' THEN 1.0::DOUBLE ELSE 0 END)")} AS vlm_escalation_rate
        FROM v_annotation GROUP BY kind""",
)
def _(t):
    return results.escalation_rate(t("v_annotation"), "kind")


@query(
    "exam_summary",
    f"""WITH h AS (
         SELECT exam_id, count(*) AS sheet_count, count(*) FILTER (WHERE status = 'APPROVED') AS approved_count,
           count(*) FILTER (WHERE band = 'GREEN') AS green, count(*) FILTER (WHERE band = 'ORANGE') AS orange,
           count(*) FILTER (WHERE band = 'RED') AS red,
           count(*) FILTER (WHERE total >= 0 AND total < 5) AS marks_0_4,
           count(*) FILTER (WHERE total >= 5 AND total < 9) AS marks_5_8,
           count(*) FILTER (WHERE total >= 9 AND total < 13) AS marks_9_12,
           count(*) FILTER (WHERE total >= 13 AND total < 17) AS marks_13_16,
           count(*) FILTER (WHERE total >= 17 AND total < 21) AS marks_17_20,
           {r("sum(confidence::DECIMAL(18,6))::DOUBLE / count(*)")} AS avg_confidence
         FROM s_live GROUP BY exam_id),
       m AS (SELECT exam_id, string_agg(concat(concept_text, ':', missing, '/', partial, '/', covered), '; ' ORDER BY rank)
             AS most_missed FROM s_top GROUP BY exam_id)
       SELECT e.exam_id, coalesce(sheet_count, 0) AS sheet_count, coalesce(approved_count, 0) AS approved_count,
         coalesce(green, 0) AS green, coalesce(orange, 0) AS orange, coalesce(red, 0) AS red,
         coalesce(marks_0_4, 0) AS marks_0_4, coalesce(marks_5_8, 0) AS marks_5_8, coalesce(marks_9_12, 0) AS marks_9_12,
         coalesce(marks_13_16, 0) AS marks_13_16, coalesce(marks_17_20, 0) AS marks_17_20,
         coalesce(avg_confidence, 0) AS avg_confidence, coalesce(most_missed, '') AS most_missed,
         coalesce(vlm_escalation_rate, 0) AS vlm_escalation_rate
       FROM v_exam e LEFT JOIN h ON h.exam_id = e.exam_id LEFT JOIN m ON m.exam_id = e.exam_id
       LEFT JOIN s_rate v ON v.exam_id = e.exam_id""",
)
def _(t):
    return summary.exam_summary(
        t("v_exam"), t("v_sheet"), t("v_evaluation"), t("v_concept_score"), t("v_annotation")
    )


view(
    "v_question_list",
    """
SELECT item_id AS question_id, item_id % 25 AS exam_id, concat(CAST(1 + item_id % 9 AS VARCHAR(3)),
       CASE WHEN item_id % 2 = 0 THEN 'a' ELSE 'b' END) AS number FROM benchmark
""",
)


@query(
    "exam_cards",
    f"""WITH q AS (SELECT exam_id, count(*) AS n FROM v_question_list GROUP BY exam_id),
       s AS (SELECT exam_id, count(*) AS n FROM v_sheet GROUP BY exam_id),
       l AS (SELECT exam_id, sum(total)::DOUBLE / count(*) AS a FROM s_live GROUP BY exam_id)
       SELECT e.exam_id, coalesce(q.n, 0) AS question_count, coalesce(s.n, 0) AS sheet_count, {r("l.a", 6)} AS avg_marks
       FROM v_exam e LEFT JOIN q ON q.exam_id = e.exam_id LEFT JOIN s ON s.exam_id = e.exam_id
       LEFT JOIN l ON l.exam_id = e.exam_id""",
)
def _(t):
    return results.exam_cards(t("v_exam"), t("v_question_list"), t("v_sheet"), t("v_evaluation"))


@query(
    "annotation_counts",
    "SELECT sheet_id, question_id, kind, count(*) AS n FROM v_annotation GROUP BY sheet_id, question_id, kind",
)
def _(t):
    return results.annotation_counts(t("v_annotation"))


@query(
    "escalated_counts",
    "SELECT sheet_id, sum(CASE resolved_by WHEN 'VLM' THEN 1 ELSE 0 END)::BIGINT AS escalated FROM v_annotation GROUP BY 1",
)
def _(t):
    return results.escalated_counts(t("v_annotation"))


@query(
    "concept_header",
    """SELECT sheet_id, question_id, sum(CASE WHEN status = 'COVERED' THEN 1 ELSE 0 END)::BIGINT AS covered,
       count(*) AS concepts, sum(marks)::DOUBLE AS earned, sum(max_marks)::DOUBLE AS available
       FROM v_concept_score GROUP BY sheet_id, question_id""",
)
def _(t):
    return results.concept_header(t("v_concept_score"))


@query(
    "short_label",
    """SELECT concept_text, label, count(*) AS n FROM (SELECT concept_text, CASE WHEN length(concept_text) > 42
         THEN concept_text[1:40] || '…' ELSE concept_text END AS label
       FROM (SELECT text AS concept_text FROM benchmark UNION ALL SELECT concept_text FROM v_concept_score))
       GROUP BY concept_text, label""",
)
def _(t):
    texts = t("benchmark").select(F.col("text").alias("concept_text")).union(t("v_concept_score").select("concept_text"))
    labelled = texts.select("concept_text", results.short_label().alias("label"))
    return labelled.groupBy("concept_text", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stage_rank",
    """WITH k(stage, stage_rank) AS (VALUES ('queued', 0), ('adjudication', 4), ('ocr', 5), ('scoring', 10), ('done', 12))
       SELECT s.sheet_id, s.stage, k.stage_rank::BIGINT AS stage_rank,
              round(k.stage_rank * 100 / 12)::BIGINT AS progress_pct
       FROM v_sheet s JOIN k ON k.stage = s.stage""",
)
def _(t):
    return results.with_stage_rank(t("v_sheet").select("sheet_id", "stage"))


@query(
    "elapsed_time",
    """SELECT sheet_id, date_diff('second', last_run_started_at, TIMESTAMP '2003-01-01 00:00:00') AS elapsed_s FROM v_sheet""",
)
def _(t):
    now = F.expr("TIMESTAMP_NTZ '2003-01-01 00:00:00'")
    return results.with_elapsed(t("v_sheet"), now).select("sheet_id", "elapsed_s")


@query(
    "filter_queue",
    "SELECT sheet_id, exam_id, confidence FROM v_sheet WHERE band = 'RED' AND status = 'DONE'",
)
def _(t):
    return queue.filter_queue(t("v_sheet"), "RED", "DONE").select("sheet_id", "exam_id", "confidence")


@query(
    "scope_to_teacher",
    """SELECT sheet_id, exam_id, status FROM v_sheet WHERE exam_id IN (SELECT exam_id FROM v_exam WHERE teacher_id = 2)""",
)
def _(t):
    return queue.scope_to_teacher(t("v_sheet").select("sheet_id", "exam_id", "status"), t("v_exam"), 2)


@query(
    "student_results",
    """SELECT st.user_id, s.sheet_id, e.name AS exam_name, e.subject, coalesce(x.total, 0)::DOUBLE AS total_marks,
       coalesce(x.available, 0)::DOUBLE AS max_marks
       FROM v_sheet s JOIN v_student st ON st.student_id = s.student_id JOIN v_exam e ON e.exam_id = s.exam_id
       LEFT JOIN s_totals x ON x.sheet_id = s.sheet_id WHERE s.status = 'APPROVED' AND st.user_id IS NOT NULL""",
)
def _(t):
    return queue.student_results(t("v_sheet"), t("v_evaluation"), t("v_exam"), t("v_student"))


@query(
    "redact_for_student",
    """SELECT doc_id, '' AS raw_text, '' AS crop_url, length(text)::BIGINT AS shown_chars FROM documents""",
)
def _(t):
    blocks = t("documents").select(
        "doc_id", F.col("text").alias("raw_text"), F.col("source").alias("crop_url"), F.length("text").alias("shown_chars")
    )
    return queue.redact(blocks, "block")


@query(
    "review_queue",
    """SELECT sheet_id, band, confidence, CASE band WHEN 'RED' THEN 0 WHEN 'ORANGE' THEN 1 ELSE 2 END::BIGINT AS queue_rank
       FROM v_sheet ORDER BY queue_rank, confidence, started_at DESC, sheet_id""",
)
def _(t):
    return queue.review_queue(t("v_sheet")).select("sheet_id", "band", "confidence", "queue_rank")


@query(
    "worst_concepts_first",
    """SELECT sheet_id, concept_id, status, max_marks::DOUBLE AS max_marks,
       CASE status WHEN 'MISSING' THEN 0 WHEN 'PARTIAL' THEN 1 ELSE 2 END::BIGINT AS severity
       FROM v_concept_score ORDER BY severity, max_marks DESC""",
)
def _(t):
    return queue.worst_first(t("v_concept_score")).select("sheet_id", "concept_id", "status", "max_marks", "severity")


@query("exam_order", "SELECT exam_id, name, created_day FROM v_exam ORDER BY created_day DESC, exam_id")
def _(t):
    return queue.default_order(t("v_exam"), "exam").select("exam_id", "name", "created_day")


@query("question_order", "SELECT question_id, number FROM v_question_list ORDER BY number, question_id")
def _(t):
    return queue.default_order(t("v_question_list"), "question").select("question_id", "number")


@query("student_order", "SELECT student_id, usn FROM v_student ORDER BY usn")
def _(t):
    return queue.default_order(t("v_student"), "student").select("student_id", "usn")


@query("sheet_order", "SELECT sheet_id, exam_id, status FROM v_sheet ORDER BY started_at DESC, sheet_id")
def _(t):
    return queue.default_order(t("v_sheet"), "sheet").select("sheet_id", "exam_id", "status")


@query(
    "pending_count",
    "SELECT exam_id, sum(CASE status WHEN 'DONE' THEN 1 ELSE 0 END)::BIGINT AS pending FROM v_sheet GROUP BY exam_id",
)
def _(t):
    return queue.pending_count(t("v_sheet"))


@query(
    "sheet_facts",
    """SELECT s.sheet_id, e.name AS exam_name, e.teacher_id, st.usn, st.name AS student_name FROM v_sheet s, v_exam e, v_student st
       WHERE s.exam_id = e.exam_id AND s.student_id = st.student_id""",
)
def _(t):
    return queue.sheet_facts(t("v_sheet"), t("v_exam"), t("v_student")).select(
        "sheet_id", "exam_name", "teacher_id", "usn", "student_name"
    )


@query(
    "sweep_stuck",
    """SELECT sheet_id, status AS old_status, 'FAILED' AS status, CASE status WHEN 'RUNNING'
         THEN 'Task automatically reset: worker was killed or disconnected during evaluation.'
         ELSE 'Task automatically reset: queued for longer than 15 minutes with no worker picking it up.' END AS error_message
       FROM v_sheet WHERE status = 'RUNNING' OR (status = 'QUEUED' AND
         coalesce(last_run_started_at, started_at) < TIMESTAMP '1999-01-01 00:10:00' - INTERVAL 15 MINUTE)""",
)
def _(t):
    return queue.sweep_stuck(t("v_sheet"), F.expr("TIMESTAMP_NTZ '1999-01-01 00:10:00'"), 15)


view(
    "v_evaluation_unique",
    """
SELECT o_orderkey AS evaluation_id, CAST(o_totalprice / 100000 AS DECIMAL(6,2)) AS auto_marks,
       CAST(10 AS DECIMAL(6,2)) AS max_marks,
       CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_orderkey % 10 AS DECIMAL(6,2)) END AS override_marks,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 'kept' ELSE '' END AS override_comment
FROM orders
""",
)
view(
    "v_override",
    """
SELECT user_id AS evaluation_id, event_id AS seq, event_type <> 'view' AS has_marks,
       CASE WHEN event_type <> 'error' THEN CAST(CASE WHEN value > 80 THEN -1 ELSE value / 5 END AS DECIMAL(6,2)) END
           AS new_marks,
       event_type IN ('view', 'click') AS has_comment,
       CASE WHEN event_type = 'view' THEN concat('note ', CAST(event_id AS VARCHAR(12))) END AS new_comment
FROM events
""",
)
view(
    "s_override_checked",
    """
SELECT o.*, e.max_marks, coalesce(o.has_marks AND (o.new_marks < 0 OR o.new_marks > e.max_marks), false) OR e.evaluation_id IS NULL AS bad,
       CASE WHEN e.evaluation_id IS NULL THEN 'no such evaluation' ELSE 'override_marks out of range' END AS reason
FROM v_override o LEFT JOIN v_evaluation_unique e ON o.evaluation_id = e.evaluation_id
""",
)


@query(
    "apply_overrides",
    """WITH m AS (SELECT * FROM (SELECT evaluation_id, new_marks, row_number() OVER (PARTITION BY evaluation_id ORDER BY seq DESC) AS k
            FROM s_override_checked WHERE NOT bad AND has_marks) WHERE k = 1),
       c AS (SELECT * FROM (SELECT evaluation_id, coalesce(new_comment, '') AS t, row_number() OVER (PARTITION BY evaluation_id ORDER BY seq DESC) AS k
            FROM s_override_checked WHERE NOT bad AND has_comment) WHERE k = 1)
       SELECT e.evaluation_id, e.auto_marks::DOUBLE AS auto_marks,
         CASE WHEN m.k = 1 THEN m.new_marks ELSE e.override_marks END::DOUBLE AS override_marks,
         CASE WHEN c.k = 1 THEN c.t ELSE e.override_comment END AS override_comment
       FROM v_evaluation_unique e LEFT JOIN m ON m.evaluation_id = e.evaluation_id
       LEFT JOIN c ON c.evaluation_id = e.evaluation_id""",
)
def _(t):
    updated, _ = queue.apply_overrides(t("v_evaluation_unique"), t("v_override"))
    return updated.select("evaluation_id", "auto_marks", "override_marks", "override_comment")


@query(
    "rejected_overrides",
    """SELECT evaluation_id, seq, new_marks::DOUBLE AS new_marks, reason AS reject_reason
       FROM s_override_checked WHERE bad""",
)
def _(t):
    _, rejected = queue.apply_overrides(t("v_evaluation_unique"), t("v_override"))
    return rejected.select("evaluation_id", "seq", "new_marks", "reject_reason")


@query(
    "latest_override",
    """SELECT evaluation_id, seq, has_marks, new_comment FROM (SELECT *, row_number() OVER (PARTITION BY evaluation_id
         ORDER BY seq DESC) AS k FROM v_override) WHERE k = 1""",
)
def _(t):
    return queue.latest(t("v_override").select("evaluation_id", "seq", "has_marks", "new_comment"), "evaluation_id", "seq")


@query(
    "redact_scores_and_pages",
    """SELECT sheet_id, question_id, concept_text, status, '' AS page_url FROM v_concept_score""",
)
def _(t):
    scores = t("v_concept_score").select(
        "sheet_id", "question_id", "concept_text", "status", F.col("concept_text").alias("evidence"),
        F.col("concept_text").alias("page_url"),
    )
    return queue.redact(queue.redact(scores, "concept_score"), "page")

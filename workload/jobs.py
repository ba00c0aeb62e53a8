"""End-to-end jobs: grading, indexing, calibration, sinks, exports, audits."""

from pyspark.sql import functions as F

from rubrica.functions import text, vectors
from workload import stand_ins as offline
from rubrica.operators import audit, pages
from rubrica.plans import calibrate, grade, index, transcribe
from rubrica.session import cut_lineage, shared_dir, shuffles_dropped, stored
from rubrica.sources import sinks, tables, uploads
from rubrica.streaming import jobs
from workload.answers import DIM, embedded, strip_sql, vector_sql
from workload.registry import VIEWS, query, r, view

# ---- grading whole cohorts -------------------------------------------------------------------------
view(
    "g_answer",
    f"""
SELECT concat(sheet_id, ':', question_id) AS answer_id, sheet_id, question_id, 10::DECIMAL(6,2) AS max_marks, coalesce({strip_sql(
    "string_agg(reconstructed_text, ' ' ORDER BY page_index, y, CASE WHEN content_type = 'TEXT' THEN 1 ELSE 0 END, block_no)"
)}, '') AS text, coalesce(avg(confidence), 0) AS ocr_quality FROM s_assigned WHERE sheet_id NOT IN (SELECT sheet_id FROM g_failed) GROUP BY sheet_id, question_id
""",
)
view(
    "g_failed",
    """
SELECT sheet_id, min(page_index) AS page_index FROM (
  SELECT p.sheet_id, p.page_index, p.j IS NULL OR (count(k.block_no) FILTER (WHERE k.reason IS NULL) = 0 AND count(k.reason) > 0) AS bad
  FROM s_page_json p LEFT JOIN s_judged k ON k.sheet_id = p.sheet_id AND k.page_index = p.page_index GROUP BY p.sheet_id, p.page_index, p.j)
WHERE bad GROUP BY sheet_id
""",
)
view(
    "g_concept",
    """
SELECT q.question_id, q.question_id * 100 + c.ord AS concept_id, c.ord, c.text, c.weight FROM v_exam_question q
JOIN v_concept c ON c.question_id = q.question_id % 40
""",
)
for _name in ("s_chunk", "s_concept_vec", "s_chunk_vec", "s_retrieved", "s_score"):
    _sql = VIEWS[_name].sql
    for _old in ("s_chunk_vec", "s_concept_vec", "s_retrieved", "s_chunk"):
        _sql = _sql.replace(_old, "g" + _old[1:])
    view("g" + _name[1:], _sql.replace("v_answer", "g_answer").replace("v_concept", "g_concept"))
view(
    "g_result",
    f"""
SELECT a.answer_id, a.sheet_id, a.question_id, CASE WHEN a.text = '' THEN 0 ELSE coalesce(m, 0) END::DOUBLE AS auto_marks,
  CASE WHEN a.text = '' THEN 1 ELSE {r("0.35::DOUBLE * a.ocr_quality + 0.4::DOUBLE + 0.25::DOUBLE * " + r("coalesce(k.ra, 0)"))} END AS confidence
FROM g_answer a LEFT JOIN (SELECT answer_id, sum(marks) AS m, avg(CASE WHEN agrees THEN 1.0::DOUBLE ELSE 0 END) AS ra FROM g_score GROUP BY answer_id) k
  ON k.answer_id = a.answer_id
""",
)


def _concepts(t):
    q = t("v_exam_question").select(F.col("question_id").alias("q"), (F.col("question_id") % 40).alias("question_id"))
    rows = t("v_concept").join(q, "question_id").select(
        F.col("q").alias("question_id"), (F.col("q") * 100 + F.col("ord")).alias("concept_id"), "ord", "text", "weight"
    )
    return vectors.hash_embed(rows, "text", DIM)


def _questions(t):
    return t("v_exam_question").withColumn("text", F.concat(F.lit("What is asked under "), "raw_number", F.lit("?")))


def _replies(t):
    """Replies as a stored table: each step that reads them would derive them again. What they were derived with goes."""
    with shuffles_dropped(t.spark):
        return cut_lineage(t("v_page_reply"))


def _graded(t, votes=None, replies=None):
    replies = _replies(t) if replies is None else replies
    return grade.grade_sheets(replies, t("v_doc_sheet"), _questions(t), stored(_concepts(t)), votes, embed=embedded)


BAND = "CASE WHEN {c} < 0.65 THEN 'RED' WHEN {c} < 0.8 THEN 'ORANGE' ELSE 'GREEN' END"


@query(
    "grade_evaluations",
    f"""SELECT sheet_id, question_id, auto_marks, confidence, CASE WHEN confidence = 1 AND answer_id IN (SELECT answer_id FROM g_answer WHERE text = '')
          THEN 'RED' ELSE {BAND.format(c="confidence")} END AS band FROM g_result""",
)
def _(t):
    return _graded(t).evaluations.select("sheet_id", "question_id", "auto_marks", "confidence", "band")


@query(
    "grade_concept_scores",
    """SELECT a.sheet_id, s.concept_id, s.similarity, s.status, s.marks::DOUBLE AS marks, s.evidence FROM g_score s
       JOIN g_answer a ON a.answer_id = s.answer_id""",
)
def _(t):
    return _graded(t).concept_scores.select("sheet_id", "concept_id", "similarity", "status", "marks", "evidence")


STORED_EVALUATIONS = f"""SELECT g.sheet_id, s.exam_id, g.question_id, q.number AS question_number, 'What is asked under ' || q.raw_number || '?' AS question_text,
  10::DOUBLE AS max_marks, auto_marks, confidence, CASE WHEN confidence = 1 AND answer_id IN (SELECT answer_id FROM g_answer WHERE text = '')
    THEN 'RED' ELSE {BAND.format(c="confidence")} END AS band
FROM g_result g JOIN v_doc_sheet s ON s.sheet_id = g.sheet_id JOIN v_exam_question q ON q.question_id = g.question_id"""


@query("grade_question_text", STORED_EVALUATIONS)
def _(t):
    """Evaluations as stored, with the snapshot of their question."""
    return _graded(t).evaluations.select(
        "sheet_id", "exam_id", "question_id", "question_number", "question_text", "max_marks", "auto_marks", "confidence", "band"
    )


@query("grade_annotations", "SELECT * FROM s_held_mark WHERE sheet_id NOT IN (SELECT sheet_id FROM g_failed)")
def _(t):
    """Marks as stored: run, write, read back."""
    out = shared_dir(t.spark, "graded")
    grade.write_graded(_graded(t), out)
    return grade.read_graded(t.spark, out, "annotations")


@query(
    "grade_evaluation_runs",
    f"""SELECT a.answer_id, c.concept_id, a.sheet_id, a.question_id, p AS pass_no, CASE (c.concept_id + p) % 3 WHEN 0 THEN 'COVERED' WHEN 1 THEN 'PARTIAL'
          ELSE 'MISSING' END AS verdict, 'reply ' || p AS raw_response
        FROM g_answer a JOIN g_concept c ON c.question_id = a.question_id, (SELECT unnest(range(1, 3)) AS p) WHERE a.text <> ''""",
)
def _(t):
    """Two passes of a model over every concept of every answer; those of blank answers are not kept."""
    spine = pages.question_spine(t("v_doc_sheet"), t("v_exam_question")).select(F.concat_ws(":", "sheet_id", "question_id").alias("answer_id"), "question_id")
    asked = spine.join(_concepts(t).select("question_id", "concept_id"), "question_id").withColumn("pass_no", F.explode(F.array(F.lit(1), F.lit(2))))
    names = F.array(F.lit("COVERED"), F.lit("PARTIAL"), F.lit("MISSING"))
    votes = asked.select(
        "answer_id", "concept_id", "pass_no", F.get(names, ((F.col("concept_id") + F.col("pass_no")) % 3).cast("int")).alias("verdict"),
        F.concat(F.lit("reply "), "pass_no").alias("raw_response"),
    )
    return _graded(t, votes).evaluation_runs.select("answer_id", "concept_id", "sheet_id", "question_id", "pass_no", "verdict", "raw_response")


SHEETS = f"""SELECT sheet_id, {r("c", 6)} AS confidence, {BAND.format(c="c")} AS band, 'DONE' AS status, '' AS error_message FROM (
  SELECT sheet_id, sum(confidence::DECIMAL(18,6))::DOUBLE / count(*) AS c FROM g_result GROUP BY sheet_id)
  UNION ALL SELECT sheet_id, 0, 'RED', 'FAILED', 'Evaluation failed: no readable reply for page ' || page_index FROM g_failed
    WHERE sheet_id IN (SELECT sheet_id FROM v_doc_sheet)"""


@query("grade_sheets", SHEETS)
def _(t):
    return _graded(t).sheets.select("sheet_id", F.round("confidence", 6).alias("confidence"), "band", "status", "error_message")


@query("grade_stream", SHEETS)
def _(t):
    """Replies arrive in a folder, are graded on arrival and written; a second pass over the same folder changes nothing."""
    inbox, out = shared_dir(t.spark, "inbox"), shared_dir(t.spark, "graded")
    # a sheet's pages arrive together, sheets about in order of their ids: a batch regrades whole sheets and touches few buckets
    stored(t("v_page_reply")).repartitionByRange("sheet_id").write.parquet(inbox)
    concepts = stored(_concepts(t))
    for writer in ("first", "again"):
        source = jobs.read_table_stream(t.spark, inbox, "*.parquet", t("v_page_reply").schema)
        jobs.grade_stream(
            source, t("v_doc_sheet"), _questions(t), concepts, out, shared_dir(t.spark, "stream-mark"), embedded,
            writer=writer,
        )
    sheets = grade.read_graded(t.spark, out, "sheets")
    return sheets.select("sheet_id", F.round("confidence", 6).alias("confidence"), "band", "status", "error_message")


@query(
    "transcribe_pages",
    """SELECT doc_id AS sheet_id, 0::BIGINT AS page_index, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE least(3, 1 + doc_id % 4) END AS attempts,
         CASE WHEN doc_id % 10 = 0 THEN 'no answer for ' || doc_id WHEN doc_id % 4 = 3 THEN 'it holds no JSON object' END AS error,
         CASE WHEN doc_id % 10 <> 0 AND doc_id % 4 < 3 THEN doc_id::VARCHAR END AS text FROM documents""",
)
def _(t):
    """Pages whose replies can be used at the first, second or third try, or never; the second run asks for nothing."""
    path = shared_dir(t.spark, "transcribed")
    images = t("documents").select(
        F.col("doc_id").alias("sheet_id"), F.lit(0).cast("long").alias("page_index"), F.lit(100).cast("long").alias("page_w"),
        F.lit(100).cast("long").alias("page_h"), F.encode(F.col("doc_id").cast("string"), "UTF-8").alias("content"),
    )
    transcribe.transcribe_pages(images, offline.late_model, path)
    replies = transcribe.transcribe_pages(images, offline.late_model, path)
    text = F.when(F.col("error").isNull(), F.get_json_object("reply", "$.blocks[0].raw_text"))
    return replies.select("sheet_id", "page_index", "attempts", "error", text.alias("text"))


# ---- concept index ---------------------------------------------------------------------------------
view(
    "v_indexed_before",
    f"SELECT item_id AS question_id, CASE WHEN item_id % 4 = 0 THEN sha256({strip_sql('text')}) ELSE 'old' END AS model_answer_hash FROM benchmark",
    lambda t: t("benchmark").selectExpr(
        "item_id AS question_id", "CASE WHEN item_id % 4 = 0 THEN sha2(trim(text), 256) ELSE 'old' END AS model_answer_hash"
    ),
)
INDEXED = f"""SELECT question_id, ord, text, weight, {r("v[1] / n", 6)} AS v1 FROM (
  SELECT *, sqrt(list_dot_product(v, v)) AS n FROM (SELECT *, {vector_sql("h")} AS v FROM (
    SELECT *, sha256(concat(lower({strip_sql("text")}), '#0')) AS h FROM v_concept WHERE question_id % 4 <> 0)))"""


def _index(t, *models):
    new = t("v_question").select("question_id", F.lit("q").alias("question"), "model_answer")
    concepts, _ = index.index_questions(new, t("v_indexed_before"), *models, embed=embedded)
    return concepts.select("question_id", "ord", "text", "weight", F.round(F.col("embedding")[0], 6).alias("v1"))


@query("index_questions", INDEXED)
def _(t):
    return _index(t)


ENDS = f"""SELECT question_id, 0 AS ord, {strip_sql("left(a, 20)")} AS text, 0.25::DOUBLE AS weight FROM (SELECT question_id, {strip_sql("model_answer")} AS a FROM v_question)
  UNION ALL SELECT question_id, 1, {strip_sql("right(a, 20)")}, 0.75::DOUBLE FROM (SELECT question_id, {strip_sql("model_answer")} AS a FROM v_question)"""


@query("index_with_models", INDEXED.replace("FROM v_concept WHERE", f"FROM (SELECT question_id, ord::BIGINT AS ord, text, weight FROM ({ENDS})) WHERE"))
def _(t):
    return _index(t, offline.drawing_model, offline.hash_model(DIM))


@query(
    "write_concepts",
    """SELECT question_id, ord, text, true AS stamped FROM v_concept WHERE question_id % 2 = 0
       UNION ALL SELECT question_id, ord, upper(text), true FROM v_concept WHERE question_id % 2 = 1""",
)
def _(t):
    """Index everything, then index the odd questions again with new texts: theirs are replaced, the others stay."""
    path = shared_dir(t.spark, "concepts")
    rows = t("v_concept").select("question_id", "ord", "text", "weight")
    sinks.write_concepts(rows, path, per_bucket=8)
    sinks.write_concepts(rows.where("question_id % 2 = 1").withColumn("text", text.upper("text")), path, per_bucket=8)
    stored = t.spark.read.parquet(path)
    return stored.select("question_id", "ord", "text", F.col("concepts_indexed_at").isNotNull().alias("stamped"))


@query(
    "write_results",
    """SELECT sheet_id, question_id, CASE WHEN status = 'DONE' THEN auto_marks + 1 ELSE auto_marks END::DOUBLE AS auto_marks, count(*) AS n
       FROM (SELECT e.*, s.status FROM v_evaluation e JOIN v_sheet s ON s.sheet_id = e.sheet_id) GROUP BY 1, 2, 3""",
)
def _(t):
    """Write every evaluation, then regrade the finished sheets: their rows are replaced once, whatever the repeats."""
    path = shared_dir(t.spark, "results")
    joined = t("v_evaluation").join(t("v_sheet").select("sheet_id", "exam_id", "status"), "sheet_id")
    rows = joined.select("exam_id", "sheet_id", "question_id", "auto_marks")
    again = joined.where("status = 'DONE'").select(
        "exam_id", "sheet_id", "question_id", (F.col("auto_marks") + 1).cast("decimal(6,2)").alias("auto_marks")
    )
    sinks.write_results(rows, path, per_bucket=20_000)
    for _ in range(2):
        sinks.write_results(again, path, per_bucket=20_000)
    stored = t.spark.read.parquet(path)
    return stored.groupBy("sheet_id", "question_id", "auto_marks").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sheet_documents",
    f"""SELECT g.sheet_id, g.question_id, g.auto_marks, CASE WHEN confidence = 1 AND k.text = '' THEN 'RED' ELSE {BAND.format(c="confidence")} END AS band,
          coalesce(s.v, '') AS scores, coalesce(b.v, '') AS blocks, coalesce(m.v, '') AS marks, coalesce(p.n, 0) AS pages
        FROM g_result g JOIN g_answer k ON k.answer_id = g.answer_id
        LEFT JOIN (SELECT s.answer_id, string_agg(s.concept_id || '=' || s.status, ',' ORDER BY c.ord) AS v FROM g_score s
          JOIN g_concept c ON c.concept_id = s.concept_id GROUP BY s.answer_id) s ON s.answer_id = g.answer_id
        LEFT JOIN (SELECT sheet_id, question_id, string_agg(concat(sheet_id, '/', page_index, '/', block_no, ' ', reconstructed_text), '|'
          ORDER BY concat(sheet_id, '/', page_index, '/', block_no)) AS v FROM s_assigned WHERE block_no IS NOT NULL GROUP BY 1, 2) b
          ON b.sheet_id = g.sheet_id AND b.question_id = g.question_id
        LEFT JOIN (SELECT sheet_id, question_id, string_agg(concat(sheet_id, '/', page_index, '/', block_no, ':', part_no * 1000 + mark_no, ' ', kind, ' ',
            x::BIGINT, ' ', y::BIGINT), ',' ORDER BY concat(sheet_id, '/', page_index, '/', block_no), part_no * 1000 + mark_no) AS v
          FROM s_held_mark GROUP BY 1, 2) m ON m.sheet_id = g.sheet_id AND m.question_id = g.question_id
        LEFT JOIN (SELECT sheet_id, count(*) AS n FROM v_page_reply GROUP BY sheet_id) p ON p.sheet_id = g.sheet_id""",
)
def _(t):
    """Documents of a grading run, read back: every evaluation with its scores, blocks and marks."""
    replies = _replies(t)
    graded = _graded(t, replies=replies)
    block_id = F.concat_ws("/", "sheet_id", "page_index", "block_no").alias("block_id")
    number = (F.col("part_no") * 1000 + F.col("mark_no")).alias("mark_no")
    docs = sinks.sheet_documents(
        t("v_doc_sheet"),
        graded.evaluations.select("sheet_id", "question_id", "auto_marks", "band"),
        graded.concept_scores.select("sheet_id", "question_id", "ord", "concept_id", "status"),
        graded.blocks.select("sheet_id", "question_id", block_id, "reconstructed_text"),
        graded.annotations.select("sheet_id", block_id, number, "kind", "x", "y"),
        replies.select("sheet_id", "page_index"),
    )
    mark = "struct<mark_no:bigint,kind:string,x:double,y:double>"
    block = f"struct<block_id:string,reconstructed_text:string,annotations:array<{mark}>>"
    score = "struct<ord:int,concept_id:bigint,status:string>"
    shape = f"evaluations array<struct<question_id:bigint,auto_marks:double,band:string,concept_scores:array<{score}>,blocks:array<{block}>>>, pages array<struct<page_index:bigint>>"
    d = docs.select("sheet_id", F.from_json("document", shape).alias("d"))
    rows = d.select("sheet_id", F.coalesce(F.size("d.pages"), F.lit(0)).alias("pages"), F.explode("d.evaluations").alias("e"))
    none = lambda a, kind: F.coalesce(a, F.array().cast(f"array<{kind}>"))

    def of_block(b):
        return F.transform(
            none(b["annotations"], mark),
            lambda m: F.concat(b["block_id"], F.lit(":"), m["mark_no"], F.lit(" "), m["kind"], F.lit(" "), m["x"].cast("bigint"), F.lit(" "), m["y"].cast("bigint")),
        )

    return rows.select(
        "sheet_id", "e.question_id", "e.auto_marks", "e.band",
        F.array_join(F.transform(none(F.col("e.concept_scores"), score), lambda c: F.concat(c["concept_id"], F.lit("="), c["status"])), ",").alias("scores"),
        F.array_join(F.transform(none(F.col("e.blocks"), block), lambda b: F.concat(b["block_id"], F.lit(" "), F.coalesce(b["reconstructed_text"], F.lit("")))), "|").alias("blocks"),
        F.array_join(F.flatten(F.transform(none(F.col("e.blocks"), block), of_block)), ",").alias("marks"),
        "pages",
    )


# ---- sources ---------------------------------------------------------------------------------------
@query(
    "read_pages",
    """SELECT page_id // 10 AS sheet_id, page_id % 10 AS page_index, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdf'
         WHEN 2 THEN 'image/jpeg' END AS content_type, strlen(html)::BIGINT + 1 AS length FROM pages""",
)
def _(t):
    """Store each web page as a sheet's page file, then list the files by sheet, index and type."""
    path = shared_dir(t.spark, "pages")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("png", "pdf", "JPG", "gif")]), (F.col("page_id") % 4 + 1).cast("int"))
    name = F.concat(F.floor(F.col("page_id") / 10), F.lit("/"), F.col("page_id") % 10, F.lit("."), ext)
    rows = t("pages").select(name.alias("name"), F.concat("html", F.lit("\n")).alias("body"))

    def store(batches):
        import pyarrow.fs as pafs

        files, root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for pdf in batches:
            for one, body in zip(pdf["name"], pdf["body"], strict=True):
                files.create_dir(f"{root}/{one.rsplit('/', 1)[0]}", recursive=True)
                with files.open_output_stream(f"{root}/{one}") as sink:
                    sink.write(body.encode())
            yield pdf[["name"]]

    rows.mapInPandas(store, "name string").write.format("noop").mode("overwrite").save()
    return uploads.read_pages(t.spark, path).select("sheet_id", "page_index", "content_type", "length")


@query(
    "read_pairs",
    """SELECT 'a' || chr(34) || source AS text1, lang AS text2, (n_chars % 6)::DOUBLE / 5 AS human, count(*) AS n FROM documents GROUP BY 1, 2, 3""",
)
def _(t):
    """Write tab-separated pair files without headings, with stray quotes in its texts, then scan all of it."""
    path = shared_dir(t.spark, "pairs")
    pad = [F.lit(str(i)).alias(f"h{i}") for i in range(7)]
    line = t("documents").select(
        F.concat_ws("\t", *pad, F.concat(F.lit('a"'), "source"), "lang", F.format_number((F.col("n_chars") % 6).cast("double"), 3)).alias("value")
    )
    line.write.option("header", "false").text(path)
    return tables.read_pairs(t.spark, path, heading=False).groupBy("text1", "text2", "human").agg(F.count(F.lit(1)).alias("n"))


@query(
    "extract_test_cases",
    f"""SELECT doc_id, 1::BIGINT AS case_no, source AS title, {strip_sql("text")} AS question, 'answer ' || lang AS model_answer
        FROM documents UNION ALL SELECT doc_id, 3, 'last', 'q', {strip_sql("text")} FROM documents""",
)
def _(t):
    fence = "\n\n```text\n"
    doc = t("documents").select(
        "doc_id",
        F.concat(
            F.lit("# Cases\n\n## Test "), "source", F.lit(f"\n\n### Question{fence}"), "text", F.lit(f"\n```\n\n### Model Answer{fence}answer "),
            "lang", F.lit("\n```\n"), F.lit(f"\n## Test half\n\n### Questions{fence}only\n```\n"),
            F.lit(f"\n## Test last\n\n### Questions{fence}q\n```\n\n### Model Answer{fence}"), "text", F.lit("\n```\n"),
        ).alias("value"),
    )
    cases = tables.extract_test_cases(doc.withColumnRenamed("doc_id", "doc"))
    return cases.withColumnRenamed("doc", "doc_id")


# ---- calibration -----------------------------------------------------------------------------------
view(
    "v_label",
    """
SELECT l.doc_id, d.lang, CAST(l.quality AS DOUBLE) AS human, CAST((d.n_chars * 7 + l.doc_id * 13) % 1000 AS DOUBLE) / 1000 AS similarity
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
""",
)
def _report(src, by=""):
    def mean(cond):
        return r(f"avg(human) FILTER (WHERE similarity {cond})")

    spread = "stddev_pop(similarity) * stddev_pop(human)"
    cuts = {"a": "0.72", "b": "0.5"}
    cols = ", ".join(
        f"count(*) FILTER (WHERE similarity >= {c}) AS {k}1, {mean('>= ' + c)} AS {k}2, count(*) FILTER (WHERE similarity < {c}) AS {k}3,"
        f" {mean('< ' + c)} AS {k}4"
        for k, c in cuts.items()
    )
    rows = ", ".join(
        f"struct_pack(threshold := {c}::DOUBLE, above := {k}1, mean_above := {k}2, below := {k}3, mean_below := {k}4)" for k, c in cuts.items()
    )
    group = f"GROUP BY {by.rstrip(',')}" if by else ""
    return f"""SELECT {by} n, pearson_r, c.threshold, c.above, c.mean_above, c.below, c.mean_below FROM (
      SELECT {by} n, pearson_r, unnest([{rows}]) AS c FROM (SELECT {by} count(*) AS n,
        CASE WHEN {spread} > 0 THEN {r(f"covar_pop(similarity, human) / ({spread})")} END AS pearson_r, {cols} FROM {src} {group}))"""


@query("calibration_report", _report("v_label", "lang,"))
def _(t):
    return calibrate.calibrate(t("v_label"), by=["lang"])


view(
    "s_pair_similarity",
    f"""
SELECT human, (list_dot_product(a, b) / sqrt(list_dot_product(a, a)) / sqrt(list_dot_product(b, b)) + 1) / 2 AS similarity FROM (
  SELECT human, {vector_sql("ha")} AS a, {vector_sql("hb")} AS b FROM (
    SELECT (n_chars % 6)::DOUBLE / 5 AS human, sha256(concat(lower({strip_sql("text")}), '#0')) AS ha,
           sha256(concat(lower({strip_sql("concat(source, lang)")}), '#0')) AS hb FROM documents))
""",
)


@query("calibrate_pairs", _report("s_pair_similarity"))
def _(t):
    pairs = t("documents").select(
        F.col("text").alias("text1"), F.concat("source", "lang").alias("text2"), ((F.col("n_chars") % 6).cast("double") / 5).alias("human")
    )
    return calibrate.calibrate(calibrate.pair_similarity(pairs, lambda df, col, out: vectors.hash_embed(df, col, DIM, out)))


# ---- audits ----------------------------------------------------------------------------------------
def _texts(t):
    words = t("v_word").where("TRUE")
    changed = F.expr(
        "CASE WHEN word_no % 11 = 3 THEN NULL WHEN word_no % 13 = 5 THEN concat('new ', text) WHEN word_no % 7 = 2 THEN upper(text) ELSE text END"
    )
    return words.withColumn("t2", changed).groupBy("block_id").agg(
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY word_no)").alias("raw_text"),
        F.coalesce(F.expr("listagg(t2, ' ') WITHIN GROUP (ORDER BY word_no)"), F.lit("")).alias("reconstructed_text"),
    )


@query("edit_runs")
def _(t):
    return audit.edit_runs(_texts(t))


@query("edit_audit")
def _(t):
    return audit.edit_audit(_texts(t))

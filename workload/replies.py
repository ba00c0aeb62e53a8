"""Reply repair and batch model calls."""

from pyspark.sql import functions as F

from rubrica.functions import replies
from rubrica.inference import calls, prompts
from workload import stand_ins as offline
from workload.answers import strip_sql, verdict_sql, words_sql
from workload.registry import query, r, view

# Replies in the forms models give: plain, fenced, in prose, single-quoted, unreadable, without the field.
view(
    "v_reply",
    """
SELECT event_id, CASE event_id % 8
  WHEN 0 THEN replace(concat('{`verdict`: `', word, '`, `n`: ', event_id, '}'), '`', chr(34))
  WHEN 1 THEN replace(concat('```json', chr(10), '{`verdict`: `', lower(word), '`}', chr(10), '```'), '`verdict`', concat(chr(34), 'verdict', chr(34)))
  WHEN 2 THEN replace(concat('Sure. {`verdict`: `it is NOT ', word, '`} Anything else?'), '`', chr(34))
  WHEN 3 THEN replace(concat('{`verdict`: `', word, '`}'), '`', chr(39))
  WHEN 4 THEN concat('I would say ', word, ' here')
  WHEN 5 THEN replace(concat('{`grade`: `', word, '`}'), '`', chr(34))
  WHEN 6 THEN concat('{broken ', lower(word))
  ELSE 'no idea' END AS reply
FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'COVERED' WHEN 'signup' THEN 'PARTIAL' WHEN 'error' THEN 'MISSING'
        WHEN 'view' THEN 'COVERED' ELSE 'MAYBE' END AS word FROM events)
""",
)
view(
    "v_reply_fixed",
    "SELECT event_id, CASE WHEN event_id % 8 = 1 THEN replace(replace(replace(reply, '```', chr(1)), '`', chr(34)), chr(1), '```') ELSE reply END AS reply FROM v_reply",
)




@query(
    "parse_reply",
    f"""SELECT event_id, verdict, verdict IS NOT NULL OR readable AS readable FROM (
          SELECT event_id, json_extract_string(j, '$.verdict') AS verdict, j IS NOT NULL AS readable FROM (
            SELECT event_id, CASE WHEN json_valid(x) THEN x END AS j FROM (
              SELECT event_id, CASE event_id % 8 WHEN 3 THEN replace(reply, chr(39), chr(34))
                WHEN 1 THEN replace(regexp_extract(reply, '(?s)(\\{{.*\\}})', 1), '`', chr(34))
                ELSE regexp_extract(reply, '(?s)(\\{{.*\\}})', 1) END AS x FROM v_reply_fixed)))""",
)
def _(t):
    out = replies.parse_reply(t("v_reply_fixed"), "reply", "verdict string")
    return out.select("event_id", F.col("parsed.verdict").alias("verdict"), F.col("parsed").isNotNull().alias("readable"))


@query(
    "extract_verdict",
    r"""SELECT event_id, coalesce(nullif(regexp_extract(CASE WHEN event_id % 8 = 5 THEN '' ELSE upper(reply) END,
         '\b(COVERED|PARTIAL|MISSING)\b', 1), ''), 'MISSING') AS verdict FROM v_reply_fixed""",
)
def _(t):
    return replies.extract_verdict(t("v_reply_fixed")).select("event_id", "verdict")


view(
    "v_feedback_reply",
    """
SELECT doc_id, CASE WHEN lang = 'fr' THEN concat('not json at all ', lang) WHEN lang = 'de' THEN concat('Here you go: ', j) ELSE j END AS reply
FROM (SELECT doc_id, lang, replace(concat('{`strengths`: ` ', source, ' is covered. `, `gaps`: `', lang, '`',
        CASE WHEN lang = 'es' THEN '' ELSE concat(', `suggestions`: ` read ', source, '`') END, '}'), '`', chr(34)) AS j FROM documents)
""",
)


@query(
    "parse_feedback",
    """SELECT doc_id, CASE WHEN lang = 'fr' THEN '' ELSE source || ' is covered.' END AS strengths, CASE WHEN lang = 'fr' THEN '' ELSE lang END AS gaps,
       CASE WHEN lang IN ('fr', 'es') THEN '' ELSE 'read ' || source END AS suggestions FROM documents""",
)
def _(t):
    return replies.parse_feedback(t("v_feedback_reply")).drop("reply")


@query(
    "classify_error",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'The AI provider is currently overloaded or rate-limited — try again in a few minutes.'
         ELSE 'Evaluation failed: bad ' || event_type END AS message FROM events""",
)
def _(t):
    e = t("events").withColumn(
        "exc",
        F.when(F.col("event_type") == "error", F.concat(F.lit("HTTP "), F.element_at(F.array(F.lit("429"), F.lit("Rate Limit"), F.lit("Connection reset")), (F.col("event_id") % 3 + 1).cast("int"))))
        .otherwise(F.concat(F.lit("bad "), "event_type")),
    )
    return e.select("event_id", replies.classify_error("exc").alias("message"))


COVERAGE_SQL = f"""concat('<concept>', chr(10), {strip_sql("c.text")}, chr(10), '</concept>', chr(10), chr(10), '<excerpt>', chr(10),
  coalesce(nullif({strip_sql("a.text")}, ''), '(nothing relevant was retrieved from the answer)'), chr(10), '</excerpt>', chr(10), chr(10),
  'Is this concept''s own topic discussed? If not: MISSING. If fully and correctly: COVERED. Otherwise: PARTIAL.', chr(10),
  'Answer as JSON: {{"verdict": "COVERED" | "PARTIAL" | "MISSING"}}')"""


def _coverage(t):
    every = t("v_concept").select("question_id", "ord", F.col("text").alias("concept_text"))
    a = t("v_answer").select("answer_id", "question_id", F.col("text").alias("evidence"))
    return prompts.with_prompt(a.join(every, "question_id"), "coverage")


@query(
    "coverage_prompts",
    f"SELECT a.answer_id, c.ord, {COVERAGE_SQL} AS prompt FROM v_answer a JOIN v_concept c ON c.question_id = a.question_id",
)
def _(t):
    return _coverage(t).select("answer_id", "ord", "prompt")


@query(
    "concept_prompts",
    f"""SELECT question_id, concat('Question: q', question_id, chr(10), chr(10),
          'List up to 8 facts of the model answer that can each be graded alone, with a weight per fact; the weights sum to 1. ',
          'A one-phrase answer is one fact.', chr(10), 'Answer as JSON: {{"concepts": [{{"text": "...", "weight": 0.5}}]}}', chr(10), chr(10),
          '<model_answer>', chr(10), {strip_sql("model_answer")}, chr(10), '</model_answer>') AS prompt FROM v_question""",
)
def _(t):
    q = t("v_question").withColumn("question", F.concat(F.lit("q"), "question_id"))
    return prompts.with_prompt(q, "concepts").select("question_id", "prompt")


@query(
    "feedback_prompts",
    """SELECT sheet_id, concat('A student''s answer was graded fact by fact.', chr(10), chr(10), string_agg(concat('(', lower(status), ') ', concept_text), chr(10)
         ORDER BY concept_text, status), chr(10), chr(10), 'Tell them what went well, what is lacking and what to read again. Answer as JSON: ',
         '{"strengths": "...", "gaps": "...", "suggestions": "..."}') AS prompt
       FROM v_concept_score GROUP BY sheet_id""",
)
def _(t):
    rows = t("v_concept_score").withColumn("ord", F.struct("concept_text", "status"))
    return prompts.feedback_prompts(rows, ["sheet_id"])


@query(
    "call_text_model",
    f"""SELECT answer_id, ord, {offline.drawn_sql("prompt")} AS verdict, 1::BIGINT AS attempts FROM (
          SELECT a.answer_id, c.ord, {COVERAGE_SQL} AS prompt FROM v_answer a JOIN v_concept c ON c.question_id = a.question_id)""",
)
def _(t):
    called = calls.call_text(_coverage(t).select("answer_id", "ord", "prompt"), "prompt", offline.drawing_model)
    return replies.extract_verdict(called).select("answer_id", "ord", "verdict", "attempts")


def _stubborn():
    """Model that only answers properly once it has been told its reply was bad; some prompts never succeed."""

    def reply(prompt: str) -> str:
        key = len(prompt.split("\n")[0])
        tries = prompt.count("The reply was:")
        if key % 5 == 0:
            return "still no json"
        if key % 5 == 1:
            raise RuntimeError("connection reset")
        return '{"verdict": "PARTIAL"}' if tries or key % 5 == 2 else "PARTIAL, I think"

    return reply


@query(
    "call_with_repair",
    """SELECT doc_id, CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END::BIGINT AS attempts,
         CASE k WHEN 0 THEN 'reply is not valid JSON' WHEN 1 THEN 'connection reset' END AS error,
         CASE k WHEN 0 THEN 'still no json' WHEN 1 THEN NULL ELSE '{"verdict": "PARTIAL"}' END AS reply
       FROM (SELECT doc_id, length(concat('x', source, lang, repeat('y', (n_chars % 7)::INT))) % 5 AS k FROM documents)""",
)
def _(t):
    p = t("documents").select(
        "doc_id", F.expr("concat('x', source, lang, repeat('y', cast(n_chars % 7 as int)), '\n', text)").alias("prompt")
    )
    return calls.call_with_repair(p, "prompt", _stubborn).select("doc_id", "attempts", "error", "reply")


@query(
    "call_image_model",
    """SELECT page_id, concat(strlen(html), ':', url) AS reply FROM pages""",
)
def _(t):
    p = t("pages").select("page_id", F.encode("html", "UTF-8").alias("content"), "url")
    called = calls.call_image(p, "content", "url", lambda: lambda content, prompt: f"{len(content)}:{prompt}")
    return called.select("page_id", "reply")


@query(
    "call_embedding_model",
    f"""SELECT doc_id, {r("v[1] / n", 6)} AS v1, {r("v[16] / n", 6)} AS v16 FROM (SELECT doc_id, v, sqrt(list_dot_product(v, v)) AS n FROM (
          SELECT doc_id, list_transform(range(0, 16), lambda i: ('0x' || substr(h, 4 * i + 1, 4))::INT / 32767.5::DOUBLE - 1) AS v FROM (
            SELECT doc_id, sha256(concat(lower({strip_sql("text")}), '#0')) AS h FROM documents)))""",
)
def _(t):
    out = calls.call_embed(t("documents").select("doc_id", "text"), "text", offline.hash_model(16))
    return out.select("doc_id", F.round(F.col("embedding")[0], 6).alias("v1"), F.round(F.col("embedding")[15], 6).alias("v16"))


@query(
    "paced_calls",
    "SELECT conv_id, turn, length(text)::VARCHAR AS reply FROM conversations",
)
def _(t):
    """Calls over a table dealt to a few partitions, which bounds how many run at a time; a client keeps its own pace."""
    rows = t("conversations").select("conv_id", "turn", "text").repartition(4)
    return calls.call_text(rows, "text", lambda: lambda prompt: str(len(prompt))).select("conv_id", "turn", "reply")


@query(
    "call_stats",
    f"""SELECT event_type AS provider, count(*) AS calls, sum(user_id % 3)::BIGINT AS retries, count(CASE WHEN user_id % 7 = 0 THEN 1 END) AS failures,
        {r("sum(value::DECIMAL(24,4))::DOUBLE / count(*)")} AS mean_latency_ms, {r("max(value)")} AS max_latency_ms FROM events GROUP BY event_type""",
)
def _(t):
    log = t("events").select(
        F.col("event_type").alias("provider"), (F.col("user_id") % 3 + 1).alias("attempts"),
        F.expr("CASE WHEN user_id % 7 = 0 THEN 'failed' END").alias("error"), F.col("value").alias("latency_ms"),
    )
    return calls.call_stats(log, "provider")




view(
    "v_concept_reply",
    """
SELECT doc_id, CASE WHEN lang = 'es' THEN 'no concepts here' WHEN lang = 'de' THEN concat('```json', chr(10), j, chr(10), '```') ELSE j END AS reply
FROM (SELECT doc_id, lang, replace(concat('{`concepts`: [{`text`: `about ', source, '`, `weight`: 0.25}, {`text`: ` `, `weight`: `0.5`}, {`text`: `',
        lang, '`, `weight`: ', CASE WHEN lang = 'fr' THEN '`much`' ELSE '0.5' END, '}]}'), '`', chr(34)) AS j FROM documents)
""",
)


@query(
    "parse_concepts",
    """SELECT doc_id, ord::BIGINT AS ord, CASE ord WHEN 0 THEN 'about ' || source WHEN 1 THEN ' ' ELSE lang END AS text,
         CASE ord WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 ELSE CASE WHEN lang = 'fr' THEN 0 ELSE 0.5 END END::DOUBLE AS weight
       FROM documents, range(0, 3) g(ord) WHERE lang <> 'es'""",
)
def _(t):
    return replies.parse_concepts(t("v_concept_reply"), "doc_id")

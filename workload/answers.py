"""Chunking, rubric concepts, retrieval, votes and the scoring of answers."""

from pyspark.sql import functions as F

from rubrica.config import WS
from rubrica.functions import scoring, text, vectors
from rubrica.operators import retrieval, rubric
from rubrica.plans import score
from rubrica.session import cut_lineage
from workload.registry import query, r, view

DIM = 16


def embedded(df, col):
    """Vectors of DIM numbers, few enough for the oracles to spell out."""
    return vectors.hash_embed(df, col, DIM)


STOP = (
    "['a','an','the','is','are','was','were','of','in','on','to','for','and','or','it','its','that','this','as','by',"
    "'with','be']"
)


def strip_sql(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def rstrip_sql(x):
    return f"regexp_replace({x}, '{WS}+$', '')"


def words_sql(x):
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z]+')), lambda w: NOT list_contains({STOP}, w))"


def verdict_sql(a, b):
    share = f"len(list_intersect({a}, {b}))::DOUBLE / len({a})"
    return (
        f"CASE WHEN len({a}) = 0 THEN 'MISSING' WHEN {share} >= 0.5 THEN 'COVERED' WHEN {share} >= 0.2 THEN 'PARTIAL' "
        "ELSE 'MISSING' END"
    )


def vector_sql(h):
    return f"list_transform(range(0, {DIM}), lambda i: ('0x' || substr({h}, 4 * i + 1, 4))::INT / 32767.5::DOUBLE - 1)"


view(
    "v_question",
    """
SELECT item_id AS question_id, item_id % 25 AS exam_id, CAST(5 + item_id % 6 AS DECIMAL(6,2)) AS max_marks,
       text AS model_answer
FROM benchmark
""",
)
view(
    "v_answer",
    """
SELECT doc_id AS answer_id, doc_id % (SELECT count(*) FROM benchmark) AS question_id,
       CASE WHEN doc_id % 50 = 13 THEN ' ' ELSE text END AS text, CAST(10 AS DECIMAL(6,2)) AS max_marks,
       CAST(doc_id % 11 AS DOUBLE) / 10 AS ocr_quality,
       doc_id * 13 % 400 AS u_start, doc_id * 13 % 400 + 60 AS u_end
FROM documents
""",
)
view(
    "s_sentence",
    f"""
SELECT question_id, sentence, row_number() OVER (PARTITION BY question_id ORDER BY i) - 1 AS ord FROM (
  SELECT question_id, i, {strip_sql("x")} AS sentence FROM (
    SELECT question_id, string_split(regexp_replace({strip_sql("model_answer")}, '([.!?]){WS}+', '\\1' || chr(57344), 'g'),
           chr(57344)) AS parts FROM v_question) p, unnest(p.parts) WITH ORDINALITY AS u(x, i))
WHERE sentence <> ''
""",
)


def _concepts(t):
    return rubric.sentence_concepts(t("v_question"), "question_id", "model_answer")


view(
    "v_raw_concept",
    """
SELECT s.question_id, s.ord, s.sentence AS text, round(1.0::DOUBLE / n, 6) AS weight
FROM s_sentence s JOIN (SELECT question_id, least(count(*), 8) AS n FROM s_sentence GROUP BY question_id) c
  ON s.question_id = c.question_id WHERE s.ord < 8
""",
    _concepts,
)
view(
    "v_concept",
    """
SELECT question_id, question_id * 100 + ord AS concept_id, ord, text,
  (w + CASE WHEN ord = max(ord) OVER (PARTITION BY question_id) THEN 1 - sum(w) OVER (PARTITION BY question_id) ELSE 0 END)
    ::DOUBLE AS weight
FROM (SELECT question_id, ord, text,
        round(weight / sum(weight::DECIMAL(18,6)) OVER (PARTITION BY question_id)::DOUBLE, 6)::DECIMAL(18,6) AS w
      FROM v_raw_concept)
""",
    lambda t: rubric.normalise_weights(_concepts(t), "question_id").select(
        "question_id", (F.col("question_id") * 100 + F.col("ord")).alias("concept_id"), "ord", "text", "weight"
    ),
)
view(
    "s_chunk",
    f"""
SELECT answer_id, question_id, row_number() OVER (PARTITION BY answer_id ORDER BY start0) - 1 AS chunk_no,
       {rstrip_sql("raw")} AS text, start0 AS s, start0 + length({rstrip_sql("raw")}) AS e
FROM (
  SELECT answer_id, question_id, sno, g, string_agg(raw, '' ORDER BY cno) AS raw, min(s0 + c0) AS start0 FROM (
    SELECT *, sum(CASE WHEN cno = 1 OR length(regexp_replace(raw, ',{WS}+$', '')) >= 15 THEN 1 ELSE 0 END)
                OVER (PARTITION BY answer_id, sno ORDER BY cno) AS g,
           sum(length(raw)) OVER (PARTITION BY answer_id, sno ORDER BY cno) - length(raw) AS c0
    FROM (
      SELECT answer_id, question_id, sno, s0, u.raw, u.cno FROM (
        SELECT *, CASE WHEN length(sentence) > 90
                    THEN string_split(regexp_replace(sentence, '(,{WS}+)', '\\1' || chr(57344), 'g'), chr(57344))
                    ELSE [sentence] END AS clauses
        FROM (SELECT *, {rstrip_sql("seg")} AS sentence,
                     sum(length(seg)) OVER (PARTITION BY answer_id ORDER BY sno) - length(seg) AS s0
              FROM (SELECT answer_id, question_id, u.seg, u.sno FROM (
                      SELECT answer_id, question_id, string_split(regexp_replace({strip_sql("text")}, '([.!?]{WS}+)',
                        '\\1' || chr(57344), 'g'), chr(57344)) AS segs FROM v_answer) a,
                    unnest(a.segs) WITH ORDINALITY AS u(seg, sno)) WHERE seg <> '')) x,
        unnest(x.clauses) WITH ORDINALITY AS u(raw, cno)))
  GROUP BY answer_id, question_id, sno, g)
WHERE {rstrip_sql("raw")} <> ''
""",
)


@query("sentence_concepts", "SELECT question_id, ord, text, weight FROM v_raw_concept")
def _(t):
    return t("v_raw_concept").select("question_id", "ord", "text", "weight")


@query("normalise_weights", "SELECT question_id, ord, text, weight FROM v_concept")
def _(t):
    return t("v_concept").select("question_id", "ord", "text", "weight")


@query(
    "weight_check",
    """SELECT question_id, sum(weight::DECIMAL(18,6))::DOUBLE AS weight_sum,
       abs(sum(weight::DECIMAL(18,6))::DOUBLE - 1) <= 0.01 AS weights_ok FROM v_raw_concept GROUP BY question_id""",
)
def _(t):
    return rubric.weight_check(t("v_raw_concept"), "question_id")


view(
    "v_faulty_concept",
    """
SELECT user_id AS question_id, event_id AS seq, CASE WHEN event_type = 'error' THEN '  ' ELSE event_type END AS text,
       CASE WHEN event_type = 'view' THEN CAST(0 AS DOUBLE) ELSE round(value, 2) END AS weight
FROM events
""",
)


@query(
    "concept_order",
    """SELECT question_id, seq, text, ord FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seq) - 1 AS ord
       FROM v_faulty_concept) WHERE ord < 8""",
)
def _(t):
    return rubric.concept_order(t("v_faulty_concept"), "question_id", "seq").select("question_id", "seq", "text", "ord")


@query(
    "normalise_faulty_weights",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seq) - 1 AS ord FROM v_faulty_concept),
       k AS (SELECT * FROM o WHERE ord < 8 AND trim(text) <> '' AND weight > 0),
       w AS (SELECT *, round(weight / sum(weight::DECIMAL(18,6)) OVER (PARTITION BY question_id)::DOUBLE, 6)::DECIMAL(18,6) AS x
             FROM k)
       SELECT question_id, ord, text, (x + CASE WHEN ord = max(ord) OVER (PARTITION BY question_id)
              THEN 1 - sum(x) OVER (PARTITION BY question_id) ELSE 0 END)::DOUBLE AS weight FROM w""",
)
def _(t):
    ordered = rubric.concept_order(t("v_faulty_concept"), "question_id", "seq")
    return rubric.normalise_weights(ordered, "question_id").select("question_id", "ord", "text", "weight")


@query(
    "chunk_text",
    """SELECT answer_id, chunk_no::BIGINT AS chunk_no, text, s::BIGINT AS "start", e::BIGINT AS "end" FROM s_chunk""",
)
def _(t):
    return text.chunk_text(t("v_answer"), "text", ["answer_id"])


@query(
    "tag_spans",
    """SELECT c.answer_id, c.chunk_no::BIGINT AS chunk_no, c.s < a.u_end AND a.u_start < c.e AS underlined
       FROM s_chunk c JOIN v_answer a ON a.answer_id = c.answer_id""",
)
def _(t):
    answers = t("v_answer").withColumn("spans", F.expr("array(named_struct('s', u_start, 'e', u_end))"))
    rows = text.chunk_text(answers, "text", ["answer_id", "spans"])
    return text.tag_spans(rows).select("answer_id", "chunk_no", "underlined")


@query(
    "keyword_overlap",
    f"""SELECT answer_id, len(list_intersect(aw, qw))::BIGINT AS shared, len(qw)::BIGINT AS concept_words,
        {verdict_sql("qw", "aw")} AS verdict
        FROM (SELECT a.answer_id, {words_sql("a.text")} AS aw, {words_sql("q.model_answer")} AS qw
              FROM v_answer a JOIN v_question q ON a.question_id = q.question_id)""",
)
def _(t):
    q = t("v_question").select("question_id", text.keywords("model_answer").alias("qw"))
    a = t("v_answer").select("answer_id", "question_id", text.keywords("text").alias("aw"))
    return a.join(q, "question_id").select(
        "answer_id",
        text.keyword_overlap("aw", "qw").alias("shared"),
        F.size("qw").alias("concept_words"),
        text.keyword_verdict("qw", "aw").alias("verdict"),
    )


@query(
    "answer_hash",
    f"SELECT answer_id, sha256({strip_sql('text')}) AS model_answer_hash FROM v_answer",
)
def _(t):
    return t("v_answer").select("answer_id", text.answer_hash("text").alias("model_answer_hash"))


view(
    "v_reworded_question",
    """
SELECT doc_id AS question_id, doc_id % 25 AS exam_id, concat(CAST(1 + doc_id % 3 AS VARCHAR(3)), 'a') AS number,
       CASE WHEN source IN ('src1', 'src5') THEN concat(text, ' Also.') WHEN source = 'src2' THEN concat('  ', text, '   ')
            ELSE text END AS model_answer
FROM documents
""",
)


@query(
    "questions_to_reindex",
    f"""SELECT n.question_id, sha256({strip_sql("n.model_answer")}) AS model_answer_hash
        FROM v_reworded_question n LEFT JOIN documents d ON d.doc_id = n.question_id AND d.lang <> 'de'
        WHERE d.doc_id IS NULL OR sha256({strip_sql("d.text")}) <> sha256({strip_sql("n.model_answer")})""",
)
def _(t):
    old = t("documents").where("lang <> 'de'").select(
        F.col("doc_id").alias("question_id"), text.answer_hash("text").alias("model_answer_hash")
    )
    return rubric.questions_to_reindex(t("v_reworded_question"), old).select("question_id", "model_answer_hash")


@query(
    "stale_concepts",
    f"""SELECT c.question_id, c.ord FROM v_concept c JOIN v_question q ON q.question_id = c.question_id
        JOIN v_reworded_question n ON n.question_id = c.question_id
        WHERE sha256({strip_sql("n.model_answer")}) <> sha256({strip_sql("q.model_answer")})""",
)
def _(t):
    old = t("v_question").select("question_id", text.answer_hash("model_answer").alias("model_answer_hash"))
    changed = rubric.questions_to_reindex(t("v_reworded_question"), old)
    return rubric.stale_concepts(t("v_concept"), changed).select("question_id", "ord")


@query(
    "duplicate_numbers",
    """SELECT n.question_id, n.exam_id, n.number FROM v_reworded_question n WHERE EXISTS (
         SELECT 1 FROM v_question_list o WHERE o.exam_id = n.exam_id AND o.number = n.number AND o.question_id <> n.question_id)""",
)
def _(t):
    new = t("v_reworded_question").select("question_id", "exam_id", "number")
    return rubric.duplicate_numbers(new, t("v_question_list")).select("question_id", "exam_id", "number")


# ---- vectors ---------------------------------------------------------------------------------------
# Every vector counts: a label's eight concepts are the means of its vectors in eight slots.
view(
    "v_vector_concept",
    """
SELECT label * 8 + slot AS concept_id, label, list(m ORDER BY place) AS q_vec FROM (
  SELECT label, vec_id % 8 AS slot, place, avg(embedding[place]::DOUBLE) AS m FROM (
    SELECT *, unnest(range(1, len(embedding) + 1)) AS place FROM embeddings) GROUP BY ALL) GROUP BY label, slot
""",
    lambda t: t("embeddings")
    .select("label", (F.col("vec_id") % 8).alias("slot"), F.posexplode("embedding").alias("place", "v"))
    .groupBy("label", "slot", "place")
    .agg(F.avg(F.col("v").cast("double")).alias("m"))
    .groupBy("label", "slot")
    .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda x: x["m"]).alias("q_vec"))
    .select((F.col("label") * 8 + F.col("slot")).alias("concept_id"), "label", "q_vec"),
)
view(
    "v_vector_chunk",
    """
SELECT vec_id AS chunk_no, CAST(floor(vec_id / 8) AS BIGINT) AS answer_id, label, embedding AS c_vec,
       vec_id % 3 = 0 AS underlined
FROM embeddings
""",
)
view(
    "s_pair",
    """
SELECT q.label, q.concept_id, c.answer_id, c.chunk_no, c.underlined,
       coalesce(CASE WHEN list_dot_product(q_vec::DOUBLE[], q_vec::DOUBLE[]) * list_dot_product(c_vec::DOUBLE[], c_vec::DOUBLE[]) = 0
         THEN 0 ELSE list_cosine_similarity(q_vec::DOUBLE[], c_vec::DOUBLE[]) END, 0) AS raw
FROM v_vector_concept q JOIN v_vector_chunk c ON q.label = c.label
""",
)


def _pairs(t):
    return retrieval.similarity_join(t("v_vector_concept"), t("v_vector_chunk"), ["label"])


@query("similarity_join", f"SELECT concept_id, chunk_no, {r('raw', 6)} AS raw FROM s_pair")
def _(t):
    return _pairs(t).select("concept_id", "chunk_no", F.round("raw", 6).alias("raw"))


@query(
    "cosine_similarity",
    f"""SELECT e.vec_id, c.concept_id, {r("list_cosine_similarity(e.embedding::DOUBLE[], c.q_vec::DOUBLE[])", 6)} AS cosine
        FROM embeddings e JOIN v_vector_concept c ON c.label = e.label""",
)
def _(t):
    return t("embeddings").join(t("v_vector_concept"), "label").select(
        "vec_id", "concept_id", F.round(vectors.cosine("embedding", "q_vec"), 6).alias("cosine")
    )


@query(
    "top_k",
    f"""SELECT concept_id, chunk_no, rank, {r("raw", 6)} AS raw FROM (SELECT *, row_number() OVER (PARTITION BY concept_id
        ORDER BY raw DESC, chunk_no) AS rank FROM s_pair) WHERE rank <= 3""",
)
def _(t):
    best = retrieval.top_k(_pairs(t), ["concept_id"])
    return best.select("concept_id", "chunk_no", "rank", F.round("raw", 6).alias("raw"))


S4 = r("(raw + 1) / 2")
B4 = f"CASE WHEN underlined THEN {r('least(s * 1.1::DOUBLE, 1)')} ELSE s END"


@query(
    "similarity_scores",
    f"""SELECT answer_id, concept_id, chunk_no, s AS similarity, b AS boosted,
        CASE WHEN b >= 0.72 THEN 'COVERED' WHEN b >= 0.5 THEN 'PARTIAL' ELSE 'MISSING' END AS band
        FROM (SELECT *, {B4} AS b FROM (SELECT *, {S4} AS s FROM s_pair))""",
)
def _(t):
    return (
        _pairs(t)
        .withColumn("similarity", scoring.remap("raw"))
        .withColumn("boosted", scoring.boost("similarity", "underlined"))
        .withColumn("band", scoring.similarity_band("boosted"))
        .select("answer_id", "concept_id", "chunk_no", "similarity", "boosted", "band")
    )


@query(
    "hash_embed",
    f"""SELECT doc_id, {r("v[1] / n", 6)} AS v1, {r("v[16] / n", 6)} AS v16, len(v)::BIGINT AS dim,
        {r("list_dot_product(v, v) / (n * n)", 6)} AS sq
        FROM (SELECT doc_id, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT doc_id, {vector_sql("h")} AS v FROM (
          SELECT doc_id, sha256(concat(lower({strip_sql("text")}), '#0')) AS h FROM documents)))""",
)
def _(t):
    v = vectors.hash_embed(t("documents").select("doc_id", "text"), "text", DIM)
    return v.select(
        "doc_id",
        F.round(F.col("embedding")[0], 6).alias("v1"),
        F.round(F.col("embedding")[15], 6).alias("v16"),
        F.size("embedding").alias("dim"),
        F.round(vectors.dot("embedding", "embedding"), 6).alias("sq"),
    )


view(
    "s_embedding_check",
    """
SELECT d.doc_id, CASE WHEN e.vec_id IS NULL THEN 'missing vector'
  WHEN len(e.embedding) - e.label % 2 <> 64 THEN concat('vector has ', len(e.embedding) - e.label % 2, ' values, expected 64')
  END AS reason FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
""",
)


def _embeddings(t):
    cut = F.slice("embedding", F.lit(1), F.size("embedding") - F.col("label") % 2)
    found = t("embeddings").select(F.col("vec_id").alias("doc_id"), cut.alias("embedding"))
    return vectors.check_embeddings(t("documents").select("doc_id"), found, "doc_id", 64)


@query("accepted_embeddings", "SELECT doc_id, 64::BIGINT AS dim FROM s_embedding_check WHERE reason IS NULL")
def _(t):
    return _embeddings(t)[0].select("doc_id", F.size("embedding").alias("dim"))


@query("rejected_embeddings", "SELECT doc_id, reason FROM s_embedding_check WHERE reason IS NOT NULL")
def _(t):
    return _embeddings(t)[1]


@query(
    "fit_embeddings",
    f"""SELECT vec_id, 80::BIGINT AS padded, {r("embedding[48]::DOUBLE", 6)} AS last_kept FROM embeddings""",
)
def _(t):
    return t("embeddings").select(
        "vec_id",
        F.size(vectors.fit_length("embedding", 80)).alias("padded"),
        F.round(vectors.fit_length("embedding", 48)[47], 6).alias("last_kept"),
    )


@query(
    "embedding_batches",
    """SELECT doc_id, lang, n AS row_no, (n // 100)::BIGINT AS batch_no FROM (
         SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS n FROM documents)""",
)
def _(t):
    docs = t("documents").select("doc_id", "lang", F.floor(F.col("doc_id") / 65536).alias("bucket"))
    return retrieval.batch_no(docs, ["lang"], "doc_id", "bucket").select("doc_id", "lang", "row_no", "batch_no")


# ---- votes -----------------------------------------------------------------------------------------
view(
    "v_vote",
    """
SELECT user_id AS concept_id, event_id AS pass_no,
       CASE event_type WHEN 'purchase' THEN 'COVERED' WHEN 'signup' THEN 'COVERED' WHEN 'error' THEN 'MISSING'
            ELSE 'PARTIAL' END AS verdict
FROM events
""",
)
view(
    "s_majority",
    f"""
SELECT concept_id, verdict, passes, {r("n::DOUBLE / passes")} AS agreement FROM (
  SELECT concept_id, verdict, count(*) AS n, sum(count(*)) OVER (PARTITION BY concept_id)::BIGINT AS passes,
         row_number() OVER (PARTITION BY concept_id ORDER BY count(*) DESC, min(pass_no)) AS k
  FROM v_vote GROUP BY concept_id, verdict) WHERE k = 1
""",
)


@query("majority_vote", "SELECT concept_id, verdict, passes, agreement, agreement < 1 AS disagreed FROM s_majority")
def _(t):
    return retrieval.majority_vote(t("v_vote"), ["concept_id"])


@query(
    "pass_audit",
    """SELECT concept_id, count(*) AS passes, count(DISTINCT verdict) AS distinct_verdicts,
       count(*) FILTER (WHERE verdict = 'COVERED') AS covered, count(*) FILTER (WHERE verdict = 'PARTIAL') AS partial,
       count(*) FILTER (WHERE verdict = 'MISSING') AS missing FROM v_vote GROUP BY concept_id""",
)
def _(t):
    return retrieval.pass_audit(t("v_vote"), ["concept_id"])


@query(
    "pass_fan_out",
    "SELECT question_id, ord, p::BIGINT AS pass_no FROM v_concept, (VALUES (1), (2), (3)) t(p)",
)
def _(t):
    return retrieval.fan_out(t("v_concept").select("question_id", "ord"), 3)


# ---- scoring ---------------------------------------------------------------------------------------
view(
    "v_score_input",
    """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
       CAST(l_partkey % 101 AS DOUBLE) / 100 AS similarity, CAST(l_quantity / 100 AS DECIMAL(8,6)) AS weight,
       CAST(l_linenumber + 3 AS DECIMAL(6,2)) AS max_marks,
       CASE l_returnflag WHEN 'A' THEN 'COVERED' WHEN 'R' THEN 'PARTIAL' ELSE 'MISSING' END AS verdict,
       CAST(1 - 5 * l_tax AS DECIMAL(6,4)) AS ocr, CAST(1 - l_discount AS DECIMAL(6,4)) AS passes
FROM lineitem
""",
)


@query(
    "concept_status_and_marks",
    """SELECT l_orderkey, l_partkey, l_suppkey, similarity, verdict, status, factor::DOUBLE AS factor,
         round(weight * max_marks * factor, 2)::DOUBLE AS marks
       FROM (SELECT *, CASE status WHEN 'COVERED' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 ELSE 0.0 END AS factor FROM (
         SELECT *, CASE WHEN verdict = 'MISSING' THEN 'MISSING' WHEN verdict = 'PARTIAL' THEN 'PARTIAL'
           WHEN similarity < 0.72 THEN 'PARTIAL' ELSE 'COVERED' END AS status FROM v_score_input))""",
)
def _(t):
    return (
        t("v_score_input")
        .withColumn("status", scoring.concept_status("similarity", "verdict"))
        .withColumn("factor", scoring.status_factor("status"))
        .withColumn("marks", scoring.marks_for("weight", "max_marks", "factor"))
        .select("l_orderkey", "l_partkey", "l_suppkey", "similarity", "verdict", "status", "factor", "marks")
    )


@query(
    "composite_confidence",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, c AS confidence,
          CASE WHEN c < 0.65 THEN 'RED' WHEN c < 0.8 THEN 'ORANGE' ELSE 'GREEN' END AS band
        FROM (SELECT *, {r("0.35::DOUBLE * ocr::DOUBLE + 0.4::DOUBLE * passes::DOUBLE + 0.25::DOUBLE * similarity")} AS c
              FROM v_score_input)""",
)
def _(t):
    c = scoring.composite_confidence(F.col("ocr").cast("double"), F.col("passes").cast("double"), F.col("similarity"))
    return t("v_score_input").select(
        "l_orderkey", "l_partkey", "l_suppkey", c.alias("confidence"), scoring.confidence_band(c).alias("band")
    )


view(
    "s_concept_vec",
    f"""
SELECT *, sqrt(list_dot_product(v, v)) AS n FROM (SELECT *, {vector_sql("h")} AS v FROM (
  SELECT *, sha256(concat(lower({strip_sql("text")}), '#0')) AS h FROM v_concept))
""",
)
view(
    "s_chunk_vec",
    f"""
SELECT *, sqrt(list_dot_product(v, v)) AS n FROM (SELECT *, {vector_sql("h")} AS v FROM (
  SELECT *, sha256(concat(lower({strip_sql("text")}), '#0')) AS h FROM s_chunk))
""",
)
view(
    "s_retrieved",
    f"""
SELECT answer_id, concept_id, max(CASE WHEN rank = 1 THEN {r("(raw + 1) / 2")} END) AS similarity,
       string_agg(text, ' ' ORDER BY rank) AS evidence
FROM (SELECT c.answer_id, q.concept_id, c.text, list_dot_product(q.v, c.v) / (q.n * c.n) AS raw,
        row_number() OVER (PARTITION BY c.answer_id, q.concept_id
          ORDER BY list_dot_product(q.v, c.v) / (q.n * c.n) DESC, c.chunk_no) AS rank
      FROM s_chunk_vec c JOIN s_concept_vec q ON q.question_id = c.question_id) WHERE rank <= 3
GROUP BY answer_id, concept_id
""",
)
view(
    "s_score",
    f"""
SELECT answer_id, question_id, concept_id, ord, concept_text, ocr_quality, blank, similarity, verdict, status,
  round(weight::DECIMAL(18,8) * max_marks * CASE status WHEN 'COVERED' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 ELSE 0.0 END, 2) AS marks,
  round(weight::DECIMAL(18,8) * max_marks, 2) AS concept_max,
  CASE WHEN status = 'MISSING' THEN '' ELSE evidence END AS evidence,
  coalesce(verdict = CASE WHEN similarity >= 0.72 THEN 'COVERED' WHEN similarity >= 0.5 THEN 'PARTIAL' ELSE 'MISSING' END, false)
    AS agrees
FROM (SELECT *, CASE WHEN blank OR verdict = 'MISSING' THEN 'MISSING' WHEN verdict = 'COVERED' AND similarity >= 0.72
          THEN 'COVERED' ELSE 'PARTIAL' END AS status
      FROM (SELECT *, CASE WHEN NOT blank THEN {verdict_sql("cw", "ew")} END AS verdict
            FROM (SELECT a.answer_id, a.question_id, a.max_marks, a.ocr_quality, c.concept_id, c.ord, c.weight,
                    c.text AS concept_text, trim(a.text) = '' AS blank, coalesce(x.similarity, 0) AS similarity,
                    coalesce(x.evidence, '') AS evidence, {words_sql("c.text")} AS cw,
                    {words_sql("coalesce(x.evidence, '')")} AS ew
                  FROM v_answer a JOIN v_concept c ON c.question_id = a.question_id
                  LEFT JOIN s_retrieved x ON x.answer_id = a.answer_id AND x.concept_id = c.concept_id)))
""",
)


def _scored(t):
    concepts = vectors.hash_embed(t("v_concept"), "text", DIM)
    return score.score_answers(t("v_answer"), concepts, None, embed=embedded)


@query(
    "retrieve_evidence",
    "SELECT answer_id, concept_id, similarity, evidence FROM s_retrieved",
)
def _(t):
    return score.retrieve(t("v_answer").drop("spans"), embedded(t("v_concept"), "text"), embed=embedded)


@query(
    "score_concepts",
    """SELECT answer_id, concept_id, similarity, status, marks::DOUBLE AS marks, concept_max::DOUBLE AS max_marks, evidence,
       agrees FROM s_score""",
)
def _(t):
    scores, _ = _scored(t)
    return scores.select(
        "answer_id", "concept_id", "similarity", "status", "marks", F.col("concept_max").alias("max_marks"), "evidence", "agrees"
    )


@query(
    "score_answers",
    f"""WITH g AS (SELECT answer_id, sum(marks) AS m, avg(CASE WHEN agrees THEN 1.0::DOUBLE ELSE 0 END) AS ra,
          string_agg(concept_text, '; ' ORDER BY ord) FILTER (WHERE status = 'COVERED') AS cov,
          string_agg(concept_text, '; ' ORDER BY ord) FILTER (WHERE status <> 'COVERED') AS weak,
          arg_min(concept_text, ord) FILTER (WHERE status <> 'COVERED') AS fw FROM s_score GROUP BY answer_id),
        k AS (SELECT a.answer_id, trim(a.text) = '' AS blank, g.*, {r("0.35::DOUBLE * a.ocr_quality + 0.4::DOUBLE * 1 + 0.25::DOUBLE * " + r("g.ra"))} AS c
          FROM v_answer a LEFT JOIN g ON g.answer_id = a.answer_id)
        SELECT answer_id, CASE WHEN blank THEN 0 ELSE coalesce(m, 0) END::DOUBLE AS auto_marks,
          CASE WHEN blank THEN 1 ELSE c END AS confidence,
          CASE WHEN blank OR c < 0.65 THEN 'RED' WHEN c < 0.8 THEN 'ORANGE' ELSE 'GREEN' END AS band,
          CASE WHEN blank THEN '' WHEN cov IS NULL
            THEN 'The answer engages with the question but doesn''t clearly cover a scored concept.'
            ELSE 'The answer clearly covers: ' || cov || '.' END AS strengths,
          CASE WHEN blank THEN 'No answer provided for this question.' WHEN weak IS NULL THEN 'No concepts were missed.'
            ELSE 'Missing or only partially covered: ' || weak || '.' END AS gaps,
          CASE WHEN blank THEN 'Review the relevant concepts.' WHEN fw IS NULL
            THEN 'Keep reinforcing the concepts already covered with a worked example.'
            ELSE 'Revisit and add detail on: ' || fw || '.' END AS suggestions FROM k""",
)
def _(t):
    _, results = _scored(t)
    return results.drop("question_id", "max_marks")


@query(
    "score_with_votes",
    """WITH v AS (SELECT s.answer_id, s.concept_id, m.verdict, m.agreement FROM s_score s
                  LEFT JOIN s_majority m ON m.concept_id = s.answer_id)
       SELECT s.answer_id, s.concept_id, CASE WHEN s.blank OR v.verdict IS NULL OR v.verdict = 'MISSING' THEN 'MISSING'
         WHEN v.verdict = 'COVERED' AND s.similarity >= 0.72 THEN 'COVERED' ELSE 'PARTIAL' END AS status,
         coalesce(v.agreement < 1, false) AS disagreed
       FROM s_score s JOIN v ON v.answer_id = s.answer_id AND v.concept_id = s.concept_id""",
)
def _(t):
    concepts = vectors.hash_embed(t("v_concept"), "text", DIM)
    rows = cut_lineage(score.prepared(t("v_answer"), concepts, embed=embedded))
    votes = t("v_vote").withColumnRenamed("concept_id", "answer_id").join(
        rows.select("answer_id", "concept_id"), "answer_id"
    )
    return score.concept_scores(rows, votes).select("answer_id", "concept_id", "status", "disagreed")


@query(
    "question_confidence",
    f"""SELECT s.concept_id AS question_id, {r("0.35::DOUBLE * 0.9 + 0.4::DOUBLE * " + r("avg(a)") + " + 0.25::DOUBLE * " + r("avg(m)"))} AS confidence
        FROM (SELECT concept_id, agreement AS a, CASE WHEN verdict = CASE WHEN concept_id % 100 >= 72 THEN 'COVERED'
          WHEN concept_id % 100 >= 50 THEN 'PARTIAL' ELSE 'MISSING' END THEN 1.0::DOUBLE ELSE 0 END AS m FROM s_majority) s
        GROUP BY s.concept_id""",
)
def _(t):
    votes = retrieval.majority_vote(t("v_vote"), ["concept_id"])
    sim = (F.col("concept_id") % 100).cast("double") / 100
    q = votes.groupBy(F.col("concept_id").alias("question_id")).agg(
        F.round(F.avg("agreement"), 4).alias("p"),
        F.round(F.avg((F.col("verdict") == scoring.similarity_band(sim)).cast("double")), 4).alias("ra"),
    )
    return q.select("question_id", scoring.composite_confidence(F.lit(0.9), "p", "ra").alias("confidence"))


@query(
    "feedback_text",
    """WITH g AS (SELECT sheet_id, string_agg(concept_text, '; ' ORDER BY concept_text) FILTER (WHERE status = 'COVERED') AS cov,
         string_agg(concept_text, '; ' ORDER BY concept_text) FILTER (WHERE status <> 'COVERED') AS weak,
         min(concept_text) FILTER (WHERE status <> 'COVERED') AS fw FROM v_concept_score GROUP BY sheet_id)
       SELECT sheet_id, coalesce('The answer clearly covers: ' || cov || '.',
           'The answer engages with the question but doesn''t clearly cover a scored concept.') AS strengths,
         coalesce('Missing or only partially covered: ' || weak || '.', 'No concepts were missed.') AS gaps,
         coalesce('Revisit and add detail on: ' || fw || '.',
           'Keep reinforcing the concepts already covered with a worked example.') AS suggestions FROM g""",
)
def _(t):
    rows = t("v_concept_score").withColumn("ord", F.col("concept_text"))
    return score.feedback_text(rows, ["sheet_id"])

"""Words, lines and marks of answer blocks: reconstruction, adjudication, reconciliation."""

from pyspark.sql import functions as F

from rubrica.config import WS
from rubrica.functions import geometry, text
from rubrica.operators import greedy, marks, reconstruct, spatial
from workload.answers import strip_sql
from workload.registry import query, r, view

PER_BLOCK = 60


def _words(t):
    """Every word of every document on a ten-column grid, sixty words to a block."""
    tokens = F.split(text.strip("text"), f"{WS}+")
    return (
        t("documents")
        .select("doc_id", "lang", F.posexplode(tokens).alias("i", "text"))
        .where("text <> ''")
        .selectExpr(
            "doc_id", "lang", "doc_id * 10000 + i div 60 AS block_id", "cast(i as bigint) AS word_no", "text",
            "cast(40 * (i % 60 % 10) + (i * 7 + doc_id) % 5 as double) AS x",
            "cast(28 * (i % 60 div 10) + (i * 5 + doc_id * 3) % 9 as double) AS y",
            "cast(least(6 * length(text), 36) as double) AS w", "cast(14 as double) AS h",
        )
    )


view(
    "v_word",
    f"""
SELECT doc_id, lang, doc_id * 10000 + i // 60 AS block_id, i AS word_no, text,
       (40 * (i % 60 % 10) + (i * 7 + doc_id) % 5)::DOUBLE AS x,
       (28 * (i % 60 // 10) + (i * 5 + doc_id * 3) % 9)::DOUBLE AS y,
       least(6 * length(text), 36)::DOUBLE AS w, 14::DOUBLE AS h
FROM (SELECT doc_id, lang, u.i - 1 AS i, u.x AS text FROM (
        SELECT doc_id, lang, string_split_regex({strip_sql("text")}, '{WS}+') AS toks FROM documents) d,
      unnest(d.toks) WITH ORDINALITY AS u(x, i))
WHERE text <> ''
""",
    _words,
)
view(
    "v_mark",
    """
SELECT block_id, word_no AS mark_id, kind,
       CASE kind WHEN 'STRIKE' THEN 'CORRECTION' WHEN 'UNDERLINE' THEN 'EMPHASIS' ELSE 'INSERTION' END AS intent,
       CAST((word_no * 13 + doc_id * 7) % 101 AS DOUBLE) / 100 AS confidence, 'VLM' AS resolved_by, text,
       CASE kind WHEN 'STRIKE' THEN x - 1 WHEN 'UNDERLINE' THEN x WHEN 'ARROW' THEN x + w / 2 ELSE CAST(395 AS DOUBLE) END AS x,
       CASE kind WHEN 'STRIKE' THEN y + 5 WHEN 'UNDERLINE' THEN y + 15 WHEN 'ARROW' THEN y + 3 ELSE y END AS y,
       CASE kind WHEN 'STRIKE' THEN w + 2 WHEN 'UNDERLINE' THEN w WHEN 'ARROW' THEN 420 - x ELSE CAST(50 AS DOUBLE) END AS w,
       CASE kind WHEN 'STRIKE' THEN CAST(4 AS DOUBLE) WHEN 'UNDERLINE' THEN CAST(3 AS DOUBLE) WHEN 'ARROW' THEN CAST(12 AS DOUBLE)
            ELSE CAST(20 AS DOUBLE) END AS h
FROM (SELECT *, CASE WHEN substr(text, length(text), 1) IN ('.', ',', ';', ':', '!', '?') THEN 'MARGIN'
        WHEN length(text) >= 7 THEN 'STRIKE' WHEN upper(substr(text, 1, 1)) = substr(text, 1, 1) THEN 'ARROW'
        ELSE 'UNDERLINE' END AS kind FROM v_word)
""",
)
view(
    "v_cv_mark",
    """
SELECT block_id, word_no + 100000 AS mark_id, CASE (word_no + doc_id) % 2 WHEN 0 THEN 'STRIKE' ELSE 'UNDERLINE' END AS kind,
       CASE (word_no + doc_id) % 2 WHEN 0 THEN 'CORRECTION' ELSE 'EMPHASIS' END AS intent,
       CAST((word_no * 17 + doc_id * 5) % 100 AS DOUBLE) / 100 AS confidence, 'CV' AS resolved_by,
       x + word_no % 3 AS x, CASE WHEN word_no % 3 = 0 THEN y + 15 ELSE y + 5 END AS y, w, CAST(4 AS DOUBLE) AS h
FROM v_word
""",
)
view("v_note", "SELECT block_id, mark_id, CASE WHEN length(text) = 3 THEN '' ELSE text END AS note FROM v_mark WHERE kind = 'MARGIN'")
view("v_underlined_word", "SELECT block_id, text FROM v_word WHERE length(text) <= 4")
view(
    "v_block",
    """
SELECT block_id, CAST(400 AS DOUBLE) AS block_w, CAST(168 AS DOUBLE) AS block_h,
       CASE WHEN min(doc_id) % 10 = 3 THEN concat(chr(92), 'frac{', min(text), '}') ELSE concat(min(text), ' ', max(text)) END AS raw_text
FROM v_word GROUP BY block_id
""",
)
view(
    "v_line",
    """
SELECT block_id, word_no AS line_no,
       CASE WHEN word_no % 10 = 4 THEN 'ARROW' WHEN word_no % 2 = 0 THEN 'STRIKE' ELSE 'UNDERLINE' END AS kind,
       x AS x1, y + h AS y1, CASE WHEN word_no % 60 IN (0, 50) THEN x + 330 WHEN word_no % 10 = 4 THEN x + word_no % 7 ELSE x + w END AS x2,
       CASE WHEN word_no % 10 = 4 THEN y + h + 110 + word_no % 40 ELSE y + h + word_no % 3 END AS y2,
       CAST(word_no % 40 + 10 AS DOUBLE) AS local, CAST(doc_id * 3 % 11 AS DOUBLE) / 10 AS above,
       CAST(word_no * 7 % 11 AS DOUBLE) / 10 AS below, CAST(word_no * 3 % 50 AS DOUBLE) / 100 AS tip,
       CAST(word_no * 11 % 50 AS DOUBLE) / 100 AS tail, CAST((word_no * 29 + doc_id) % 100 AS DOUBLE) / 100 AS confidence
FROM v_word
""",
)
view(
    "v_component",
    """
SELECT block_id, word_no, CASE WHEN word_no % 60 % 10 >= 8 THEN x + 60 ELSE x END AS x, y,
       CASE WHEN word_no % 60 = 20 THEN CAST(300 AS DOUBLE) ELSE w END AS w,
       CASE WHEN word_no % 60 = 20 THEN CAST(5 AS DOUBLE) WHEN word_no % 60 = 33 AND lang = 'de' THEN CAST(90 AS DOUBLE) ELSE h END AS h,
       CASE WHEN word_no % 60 = 33 AND lang = 'de' THEN CAST(60000 AS DOUBLE) ELSE w * h - word_no % 7 * 10 END AS area
FROM v_word
""",
)


def iou_sql(a, b):
    iw = f"greatest(least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x), 0)"
    ih = f"greatest(least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y), 0)"
    union = f"({a}w * {a}h + {b}w * {b}h - {iw} * {ih})"
    return f"(CASE WHEN {iw} * {ih} <= 0 OR {union} <= 0 THEN 0 ELSE {iw} * {ih} / {union} END)"


KEYS = ["block_id", "mark_id"]


@query(
    "iou_pairs",
    f"""SELECT block_id, l_mark_id, r_mark_id, {r("v", 6)} AS iou FROM (
        SELECT a.block_id, a.mark_id AS l_mark_id, b.mark_id AS r_mark_id, {iou_sql("a.", "b.")} AS v
        FROM v_mark a JOIN v_cv_mark b ON a.block_id = b.block_id) WHERE v >= 0.3""",
)
def _(t):
    pairs = spatial.iou_pairs(t("v_mark"), t("v_cv_mark"), ["block_id"])
    return pairs.select("block_id", "l_mark_id", "r_mark_id", F.round("iou", 6).alias("iou"))


# The oracles' position joins meet on the block and on bands of 32 pixels that both rectangles touch.
BANDS = "unnest(range(floor((y - {pad}) / 32)::BIGINT, floor((y + h + {pad}) / 32)::BIGINT + 1)) AS band"
view(
    "s_hit",
    f"""
SELECT DISTINCT w.block_id, w.word_no FROM (SELECT block_id, word_no, x, y, w, h, {BANDS.format(pad=0)} FROM v_word) w
JOIN (SELECT block_id, kind, x, y, w, h, {BANDS.format(pad="CASE kind WHEN 'STRIKE' THEN 12 ELSE 0 END")} FROM v_mark) m
  ON m.block_id = w.block_id AND m.band = w.band
WHERE m.kind IN ('STRIKE', 'MARGIN') AND NOT (w.x + w.w < m.x OR m.x + m.w < w.x
  OR w.y + w.h < m.y - CASE m.kind WHEN 'STRIKE' THEN 12 ELSE 0 END OR m.y + m.h < w.y - CASE m.kind WHEN 'STRIKE' THEN 12 ELSE 0 END)
""",
)
view(
    "s_body",
    "SELECT w.* FROM v_word w LEFT JOIN s_hit k ON k.block_id = w.block_id AND k.word_no = w.word_no WHERE k.word_no IS NULL",
)
ORDERED = """
SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY line_no, x, y, word_no) - 1 AS pos FROM (
  SELECT *, sum(n) OVER (PARTITION BY block_id ORDER BY y, word_no)::BIGINT AS line_no FROM (
    SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY block_id ORDER BY y, word_no) > 12 THEN 1 ELSE 0 END AS n FROM {src}))
"""
view("s_kept", ORDERED.format(src="s_body"))
view("s_all_ordered", ORDERED.format(src="v_word"))


@query("body_words", "SELECT block_id, word_no, text FROM s_body")
def _(t):
    return reconstruct.body_words(t("v_word"), t("v_mark")).select("block_id", "word_no", "text")


@query("reading_order", "SELECT block_id, word_no, line_no, pos FROM s_all_ordered")
def _(t):
    return reconstruct.reading_order(t("v_word")).select("block_id", "word_no", "line_no", "pos")


view(
    "s_margin_arrow",
    """
SELECT m.block_id, m.mark_id, arg_min(struct_pack(i := a.mark_id, cx := a.x + a.w / 2, cy := a.y + a.h / 2, d := d), struct_pack(d := d, i := a.mark_id)) AS a
FROM (SELECT m.block_id, m.mark_id, a.mark_id AS ai, a.x, a.y, a.w, a.h,
        sqrt((m.x + m.w / 2 - a.x - a.w / 2) ** 2 + (m.y + m.h / 2 - a.y - a.h / 2) ** 2) AS d
      FROM v_mark m JOIN v_mark a ON a.block_id = m.block_id WHERE m.kind = 'MARGIN' AND a.kind = 'ARROW') x
JOIN v_mark m ON m.block_id = x.block_id AND m.mark_id = x.mark_id
JOIN v_mark a ON a.block_id = x.block_id AND a.mark_id = x.ai
WHERE d <= 300 GROUP BY m.block_id, m.mark_id
""",
)
view(
    "s_note_anchor",
    """
SELECT m.block_id, m.mark_id, n.note, coalesce(s.a.cx, m.x + m.w / 2) AS cx, coalesce(s.a.cy, m.y + m.h / 2) AS cy
FROM v_mark m JOIN v_note n ON n.block_id = m.block_id AND n.mark_id = m.mark_id AND n.note <> ''
LEFT JOIN s_margin_arrow s ON s.block_id = m.block_id AND s.mark_id = m.mark_id WHERE m.kind = 'MARGIN'
""",
)
view(
    "s_note_pos",
    """
SELECT a.block_id, a.mark_id, a.note, p.pos FROM s_note_anchor a LEFT JOIN (
  SELECT block_id, mark_id, arg_min(pos, struct_pack(d := d, p := pos)) AS pos FROM (
    SELECT a.block_id, a.mark_id, k.pos, sqrt((a.cx - k.x - k.w / 2) ** 2 + (a.cy - k.y - k.h / 2) ** 2) AS d
    FROM s_note_anchor a JOIN s_kept k ON k.block_id = a.block_id) WHERE d <= 300 GROUP BY block_id, mark_id) p
ON p.block_id = a.block_id AND p.mark_id = a.mark_id
""",
)


@query(
    "nearest_arrow",
    f"SELECT block_id, mark_id, a.i AS arrow_id, {r('a.d', 6)} AS distance FROM s_margin_arrow",
)
def _(t):
    def centres(kind):
        m = t("v_mark").where(F.col("kind") == kind)
        return m.select("block_id", "mark_id", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))

    near = spatial.nearest_within(centres("MARGIN"), centres("ARROW"), ["block_id"], "mark_id", "mark_id", 300.0)
    return near.select("block_id", "mark_id", F.col("near_mark_id").alias("arrow_id"), F.round("distance", 6).alias("distance"))


@query("anchor_notes", "SELECT block_id, mark_id, note, pos FROM s_note_pos")
def _(t):
    return reconstruct.find_anchors(t("v_word"), t("v_mark"), t("v_note"))


@query(
    "reconstruct",
    """SELECT block_id, string_agg(piece, ' ' ORDER BY pos, sub) AS reconstructed_text FROM (
         SELECT block_id, pos, -1 AS sub, text AS piece FROM s_kept UNION ALL
         SELECT block_id, coalesce(pos, -1), mark_id, CASE WHEN pos IS NULL THEN note ELSE '[' || note || ']' END FROM s_note_pos)
       GROUP BY block_id""",
)
def _(t):
    return reconstruct.reconstruct(t("v_word"), t("v_mark"), t("v_note"))


view(
    "s_above",
    """
SELECT l.block_id, l.mark_id, string_agg(w.text, ' ' ORDER BY w.x, w.word_no) AS above
FROM v_cv_mark l JOIN v_word w ON w.block_id = l.block_id AND l.y - (w.y + w.h) BETWEEN 0 AND 20
WHERE (least(l.x + l.w, w.x + w.w) - greatest(l.x, w.x)) / least(l.w, w.w) >= 0.4 AND l.kind = 'UNDERLINE'
GROUP BY l.block_id, l.mark_id
""",
)


@query("word_above_line", "SELECT block_id, mark_id, above FROM s_above")
def _(t):
    return reconstruct.word_above(t("v_cv_mark").where("kind = 'UNDERLINE'"), t("v_word"))


view(
    "s_usable",
    "SELECT c.* FROM v_cv_mark c JOIN v_block b ON b.block_id = c.block_id WHERE NOT contains(b.raw_text, chr(92) || 'frac')",
)
view(
    "s_flipped",
    f"""
SELECT block_id, mark_id, CASE WHEN flip AND kind = 'STRIKE' THEN 'UNDERLINE' WHEN flip THEN 'STRIKE' ELSE kind END AS kind,
  CASE WHEN flip AND kind = 'STRIKE' THEN 'EMPHASIS' WHEN flip THEN 'CORRECTION' ELSE intent END AS intent,
  confidence, CASE WHEN flip THEN 'CV' ELSE resolved_by END AS resolved_by, x, y, w, h
FROM (SELECT m.*, CASE kind WHEN 'STRIKE' THEN coalesce(u, 0) > coalesce(s, 0) AND u >= 0.7
          WHEN 'UNDERLINE' THEN coalesce(s, 0) > coalesce(u, 0) AND s >= 0.7 ELSE false END AS flip
      FROM v_mark m LEFT JOIN (
        SELECT a.block_id AS b_id, a.mark_id AS m_id, max(CASE WHEN b.kind = 'STRIKE' THEN b.confidence END) AS s,
               max(CASE WHEN b.kind = 'UNDERLINE' THEN b.confidence END) AS u
        FROM (SELECT *, {BANDS.format(pad=0)} FROM v_mark) a JOIN (SELECT *, {BANDS.format(pad=0)} FROM s_usable) b
          ON a.block_id = b.block_id AND a.band = b.band WHERE {iou_sql("a.", "b.")} >= 0.3 GROUP BY 1, 2) k
      ON k.b_id = m.block_id AND k.m_id = m.mark_id)
""",
)
view(
    "s_accepted",
    """
SELECT DISTINCT c.* FROM s_usable c LEFT JOIN (
  SELECT a.block_id, a.mark_id FROM s_above a JOIN v_underlined_word u ON u.block_id = a.block_id
  WHERE regexp_replace(lower(a.above), '[^0-9a-z]', '', 'g') <> '' AND regexp_replace(lower(u.text), '[^0-9a-z]', '', 'g') <> ''
    AND (contains(regexp_replace(lower(a.above), '[^0-9a-z]', '', 'g'), regexp_replace(lower(u.text), '[^0-9a-z]', '', 'g'))
      OR contains(regexp_replace(lower(u.text), '[^0-9a-z]', '', 'g'), regexp_replace(lower(a.above), '[^0-9a-z]', '', 'g')))) o
ON o.block_id = c.block_id AND o.mark_id = c.mark_id
WHERE c.kind = 'UNDERLINE' AND (c.confidence >= 0.7 OR o.mark_id IS NOT NULL)
""",
)


@query(
    "reconcile_marks",
    f"""SELECT f.block_id, f.mark_id, f.kind, f.intent, f.confidence, f.resolved_by, f.x, f.y FROM s_flipped f LEFT JOIN (
            SELECT DISTINCT f.block_id, f.mark_id FROM (SELECT *, {BANDS.format(pad=0)} FROM s_flipped WHERE kind = 'UNDERLINE') f
            JOIN (SELECT *, {BANDS.format(pad=0)} FROM s_accepted) a ON a.block_id = f.block_id AND a.band = f.band WHERE {iou_sql("f.", "a.")} >= 0.3) k
          ON k.block_id = f.block_id AND k.mark_id = f.mark_id WHERE k.mark_id IS NULL
        UNION ALL SELECT block_id, mark_id, kind, intent, confidence, resolved_by, x, y FROM s_accepted""",
)
def _(t):
    out = marks.reconcile_marks(
        t("v_mark").drop("text"), t("v_cv_mark"), t("v_word"), t("v_underlined_word"), t("v_block")
    )
    return out.select("block_id", "mark_id", "kind", "intent", "confidence", "resolved_by", "x", "y")


@query(
    "union_candidates",
    """SELECT kind, resolved_by, count(*) AS n FROM (SELECT kind, resolved_by FROM v_mark UNION ALL
       SELECT kind, resolved_by FROM v_cv_mark) GROUP BY kind, resolved_by""",
)
def _(t):
    both = marks.union_candidates(t("v_mark").drop("text"), t("v_cv_mark"))
    return both.groupBy("kind", "resolved_by").agg(F.count(F.lit(1)).alias("n"))


view(
    "v_candidate",
    """
SELECT block_id, mark_id, kind, intent, confidence, x, y, w, h FROM v_mark UNION ALL
SELECT block_id, mark_id, kind, intent, confidence, x, y, w, h FROM v_cv_mark
""",
)
view(
    "s_nms",
    f"""
SELECT block_id, unnest(list_reduce(c, lambda acc, k: CASE WHEN len(list_filter(acc, lambda p: {iou_sql("p.", "k[1].")} >= 0.3)) > 0
                        THEN acc ELSE list_concat(acc, k) END)) AS m
FROM (SELECT block_id, list([struct_pack(mark_id := mark_id, kind := kind, intent := intent, confidence := confidence,
                             x := x, y := y, w := w, h := h)] ORDER BY confidence DESC, mark_id) AS c
      FROM v_candidate GROUP BY block_id)
""",
)


@query("nms", "SELECT block_id, m.mark_id AS mark_id, m.confidence AS confidence FROM s_nms")
def _(t):
    return greedy.nms(t("v_candidate")).select("block_id", "mark_id", "confidence")


view(
    "v_mark_reply",
    """
SELECT block_id, mark_id, CASE mark_id % 7 WHEN 0 THEN 'strike.' WHEN 1 THEN 'It is an Underline' WHEN 2 THEN 'NONE'
       WHEN 3 THEN 'MARGIN or ARROW' WHEN 4 THEN 'understrike' ELSE 'arrow' END AS reply
FROM v_candidate WHERE mark_id % 11 <> 5
""",
)


@query(
    "adjudicate",
    """SELECT block_id, mark_id, kind, CASE WHEN resolved_by = 'CV' THEN intent WHEN kind = 'STRIKE' THEN 'CORRECTION'
         WHEN kind = 'UNDERLINE' THEN 'EMPHASIS' ELSE 'INSERTION' END AS intent, confidence, resolved_by
       FROM (SELECT s.block_id, m.mark_id AS mark_id, m.intent AS intent,
           CASE WHEN m.confidence >= 0.7 THEN m.kind WHEN r.reply LIKE 'strike%' THEN 'STRIKE' WHEN r.reply LIKE '%Underline' THEN 'UNDERLINE'
             WHEN r.reply = 'NONE' THEN 'NONE' WHEN r.reply LIKE 'MARGIN%' THEN 'MARGIN' WHEN r.reply = 'arrow' THEN 'ARROW' ELSE m.kind END AS kind,
           CASE WHEN m.confidence >= 0.7 THEN m.confidence ELSE 1 END AS confidence,
           CASE WHEN m.confidence >= 0.7 THEN 'CV' ELSE 'VLM' END AS resolved_by
         FROM s_nms s LEFT JOIN v_mark_reply r ON r.block_id = s.block_id AND r.mark_id = s.m.mark_id) WHERE kind <> 'NONE'""",
)
def _(t):
    out = marks.adjudicate(t("v_candidate"), t("v_mark_reply"))
    return out.select("block_id", "mark_id", "kind", "intent", "confidence", "resolved_by")


view(
    "s_line",
    """
SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS length, degrees(atan2(y2 - y1, x2 - x1)) AS angle,
       (x1 + x2) / 2 AS mid_x, (y1 + y2) / 2 AS mid_y FROM v_line
""",
)
NEAR_H = "least(abs(angle), 180 - abs(angle)) <= {}"


@query(
    "line_geometry",
    f"""SELECT block_id, line_no, {r("length", 6)} AS length, {r("angle", 6)} AS angle, mid_x, mid_y, {NEAR_H.format(12)} AS near_h,
        abs(abs(angle) - 90) <= 12 AS near_v FROM s_line""",
)
def _(t):
    g = geometry.with_geometry(t("v_line"))
    return g.select(
        "block_id", "line_no", F.round("length", 6).alias("length"), F.round("angle", 6).alias("angle"), "mid_x", "mid_y",
        "near_h", "near_v",
    )


@query(
    "score_marks",
    f"""SELECT block_id, line_no, kind, c AS confidence FROM (SELECT *, CASE kind
          WHEN 'STRIKE' THEN {r("0.5 * least(length / local, 1) + 0.5 * least(above, below)")}
          WHEN 'UNDERLINE' THEN {r("0.5 * least(length / local, 1) + 0.5 * (above * (1 - below))")}
          ELSE {r("0.5 * least(length / 60, 1) + 0.5 * least((ratio - 1) / 1.5::DOUBLE, 1)")} END AS c
        FROM (SELECT *, greatest(tip, tail) / greatest(least(tip, tail), 0.02::DOUBLE) AS ratio FROM s_line))
        WHERE (kind <> 'ARROW' AND length / local >= 0.6 AND c >= 0.15)
           OR (kind = 'ARROW' AND length >= 100 AND ratio >= 1.8 AND NOT {NEAR_H.format(8)})""",
)
def _(t):
    return marks.score_marks(geometry.with_geometry(t("v_line"))).select("block_id", "line_no", "kind", "confidence")


view(
    "s_ruled_row",
    f"""
SELECT DISTINCT block_id, floor(mid_y)::BIGINT AS at FROM (
  SELECT l.block_id, mid_y, block_h, count(*) OVER (PARTITION BY l.block_id) AS n FROM s_line l JOIN v_block b ON b.block_id = l.block_id
  WHERE {NEAR_H.format(12)} AND length >= block_w * 0.75)
WHERE n >= 3 OR mid_y <= block_h * 0.08::DOUBLE OR mid_y >= block_h - block_h * 0.08::DOUBLE
""",
)
view(
    "s_ruled_col",
    """
SELECT DISTINCT l.block_id, floor(mid_x)::BIGINT AS at FROM s_line l JOIN v_block b ON b.block_id = l.block_id
WHERE abs(abs(angle) - 90) <= 12 AND length >= block_h * 0.75
""",
)


@query(
    "flag_ruled_lines",
    """SELECT block_id, line_no, kind, hit AS on_ruling, CASE WHEN hit THEN least(confidence, 0.69) ELSE confidence END::DOUBLE AS confidence
       FROM (SELECT l.*, CASE kind WHEN 'ARROW' THEN EXISTS (SELECT 1 FROM s_ruled_col c WHERE c.block_id = l.block_id
           AND abs(floor(l.mid_x) - c.at) <= 2) ELSE EXISTS (SELECT 1 FROM s_ruled_row c WHERE c.block_id = l.block_id
           AND abs(floor(l.mid_y) - c.at) <= 2) END AS hit FROM s_line l)""",
)
def _(t):
    return marks.flag_ruled(t("v_line"), t("v_block")).select("block_id", "line_no", "kind", "on_ruling", "confidence")


@query(
    "suppress_arrow_ends",
    """WITH c AS (SELECT block_id, list([struct_pack(n := line_no, a := x1, b := y1, c := x2, d := y2)]
           ORDER BY round(length, 6) DESC, line_no) AS c FROM s_line WHERE kind = 'ARROW' GROUP BY block_id),
       k AS (SELECT block_id, unnest(list_reduce(c, lambda acc, k: CASE WHEN len(list_filter(acc, lambda p: least(
           sqrt((p.a - k[1].a) ** 2 + (p.b - k[1].b) ** 2), sqrt((p.a - k[1].c) ** 2 + (p.b - k[1].d) ** 2),
           sqrt((p.c - k[1].a) ** 2 + (p.d - k[1].b) ** 2), sqrt((p.c - k[1].c) ** 2 + (p.d - k[1].d) ** 2)) <= 45)) > 0
           THEN acc ELSE list_concat(acc, k) END)) AS m FROM c)
       SELECT block_id, m.n AS line_no FROM k""",
)
def _(t):
    return greedy.suppress_endpoints(t("v_line").where("kind = 'ARROW'")).select("block_id", "line_no")


@query("merge_collinear")
def _(t):
    out = greedy.merge_collinear(t("v_line"))
    return out.select("block_id", "line_no", "x1", "y1", "x2", "y2", "parts")


@query(
    "margin_columns",
    f"""WITH g AS (SELECT *, CASE WHEN x - max(x + w) OVER (PARTITION BY block_id ORDER BY x, y, w, h ROWS BETWEEN UNBOUNDED PRECEDING
             AND 1 PRECEDING) > 25 THEN 1 ELSE 0 END AS f FROM v_component),
        c AS (SELECT *, sum(f) OVER (PARTITION BY block_id ORDER BY x, y, w, h ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g),
        k AS (SELECT block_id, cluster, min(x) AS x1, max(x + w) AS x2, min(y) AS y1, max(y + h) AS y2, sum(area) AS area FROM c GROUP BY 1, 2),
        m AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY area DESC, cluster) = 1),
        j AS (SELECT k.*, greatest(m.x1 - k.x2, k.x1 - m.x2, 0) AS gap, greatest(1 - k.area / greatest(m.area, 1), 0) AS size
              FROM k JOIN m ON m.block_id = k.block_id AND m.cluster <> k.cluster)
        SELECT block_id, cluster, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h,
          {r("0.6 * least(gap / 120, 1) + 0.4 * size")} AS confidence FROM j WHERE gap >= 40 AND {r("0.6 * least(gap / 120, 1) + 0.4 * size")} >= 0.15""",
)
def _(t):
    return marks.margin_columns(t("v_component")).drop("kind", "intent")


@query(
    "mask_rects",
    """SELECT m.block_id, m.mark_id, greatest(0, floor(x)::BIGINT - 4) AS mx0, greatest(0, floor(y)::BIGINT - 20) AS my0,
       least(400, floor(x + w)::BIGINT + 4) AS mx1, least(168, floor(y + h)::BIGINT + 20) AS my1 FROM v_mark m WHERE kind = 'STRIKE'""",
)
def _(t):
    m = t("v_mark").where("kind = 'STRIKE'").join(t("v_block").select("block_id", "block_w", "block_h"), "block_id")
    return geometry.mask_rects(m).select("block_id", "mark_id", "mx0", "my0", "mx1", "my1")


@query(
    "math_notation",
    r"""SELECT doc_id, regexp_matches(CASE lang WHEN 'de' THEN concat(text, ' x / (y)') WHEN 'fr' THEN concat(chr(92), 'sum ', text)
         ELSE text END, '\\frac|\\sum|\\int|[A-Za-z0-9]\s*/\s*\(') AS math FROM documents""",
)
def _(t):
    raw = F.expr("CASE lang WHEN 'de' THEN concat(text, ' x / (y)') WHEN 'fr' THEN concat(chr(92), 'sum ', text) ELSE text END")
    return t("documents").select("doc_id", text.is_math(raw).alias("math"))

"""Ink profiles, gap thresholds, content types, OCR words."""

from pyspark.sql import functions as F

from rubrica.operators import layout
from workload.registry import query, r, view

view(
    "v_profile",
    """
SELECT doc_id * 1000 + CAST(floor(word_no / 600) AS BIGINT) AS page_id, word_no % 600 AS row,
       CASE WHEN length(text) > 3 OR word_no % 5 = 2 THEN length(text) ELSE 0 END AS ink
FROM v_word
""",
)
view("v_peak", "SELECT page_id, row FROM v_profile WHERE ink >= 7")
view(
    "s_run",
    """
SELECT page_id, min(row) AS top, max(row) + 1 AS bottom FROM (
  SELECT page_id, row, row - row_number() OVER (PARTITION BY page_id ORDER BY row) AS i FROM v_profile WHERE ink > 0)
GROUP BY page_id, i HAVING count(*) >= 3
""",
)
view("s_gap", "SELECT *, top - lag(bottom) OVER (PARTITION BY page_id ORDER BY top) AS gap FROM s_run")
view(
    "s_pitch",
    """
SELECT page_id, coalesce(quantile_cont(d, 0.5), 40)::DOUBLE AS pitch FROM (
  SELECT page_id, row - lag(row) OVER (PARTITION BY page_id ORDER BY row) AS d FROM v_peak) GROUP BY page_id
""",
)
view(
    "s_otsu",
    """
WITH s AS (SELECT page_id, min(gap)::DOUBLE AS lo, max(gap)::DOUBLE AS hi FROM s_gap WHERE gap IS NOT NULL GROUP BY page_id),
g AS (SELECT s.page_id, lo, lo + (CASE WHEN hi > lo THEN least(floor((gap - lo) * 256 / (hi - lo)), 255) ELSE 0 END + 0.5) * (hi - lo) / 256 AS c
      FROM s_gap g JOIN s ON s.page_id = g.page_id WHERE gap IS NOT NULL),
e AS (SELECT DISTINCT page_id, lo, c FROM g),
v AS (SELECT e.page_id, e.lo, e.c, count(*) FILTER (WHERE g.c <= e.c) AS w1, count(*) FILTER (WHERE g.c > e.c) AS w2,
        avg(g.c) FILTER (WHERE g.c <= e.c) AS m1, avg(g.c) FILTER (WHERE g.c > e.c) AS m2
      FROM e JOIN g ON g.page_id = e.page_id GROUP BY e.page_id, e.lo, e.c)
SELECT page_id, coalesce(arg_max(c, struct_pack(v := round(w1 * w2 * (m1 - m2) ** 2, 6), c := -c)) FILTER (WHERE w2 > 0), min(CASE WHEN w2 = 0 THEN lo END))
  ::DOUBLE AS otsu FROM v GROUP BY page_id
""",
)
view(
    "s_threshold",
    """
SELECT p.page_id, CASE WHEN coalesce(n, 0) < 2 THEN coalesce(pitch, 40) * 1.6::DOUBLE WHEN hi - lo < greatest(mid, 1) THEN hi + 1 ELSE otsu END::DOUBLE
  AS threshold
FROM (SELECT DISTINCT page_id FROM s_run) p
LEFT JOIN (SELECT page_id, count(gap) AS n, min(gap) AS lo, max(gap) AS hi, quantile_cont(gap, 0.5) AS mid FROM s_gap GROUP BY page_id) s
  ON s.page_id = p.page_id
LEFT JOIN s_otsu o ON o.page_id = p.page_id LEFT JOIN s_pitch k ON k.page_id = p.page_id
""",
)


@query("ink_runs", "SELECT * FROM s_run")
def _(t):
    return layout.ink_runs(t("v_profile"))


@query("line_pitch", "SELECT * FROM s_pitch")
def _(t):
    return layout.pitch(t("v_peak"))


@query("otsu_threshold", f"SELECT page_id, {r('otsu', 6)} AS otsu FROM s_otsu")
def _(t):
    gaps = layout.run_gaps(layout.ink_runs(t("v_profile")))
    return layout.otsu_threshold(gaps).select("page_id", F.round("otsu", 6).alias("otsu"))


@query("gap_thresholds", f"SELECT page_id, {r('threshold', 6)} AS threshold FROM s_threshold")
def _(t):
    gaps = layout.run_gaps(layout.ink_runs(t("v_profile")))
    out = layout.gap_thresholds(gaps, layout.pitch(t("v_peak")))
    return out.select("page_id", F.round("threshold", 6).alias("threshold"))


@query(
    "merge_runs",
    """SELECT page_id, block_no, min(top) AS top, max(bottom) AS bottom, count(*) AS lines FROM (
         SELECT g.*, (sum(CASE WHEN gap > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY g.page_id ORDER BY top))::BIGINT AS block_no
         FROM s_gap g JOIN s_threshold t ON t.page_id = g.page_id) GROUP BY page_id, block_no""",
)
def _(t):
    runs = layout.ink_runs(t("v_profile"))
    limits = layout.gap_thresholds(layout.run_gaps(runs), layout.pitch(t("v_peak")))
    return layout.merge_runs(runs, limits)


view(
    "s_regular",
    """
SELECT {by}, max(n) AS longest, (sum(n) + 1)::BIGINT AS peaks, sum(n) + 1 >= 5 AND max(n) + 1 >= 5 AS regular FROM (
  SELECT {by}, run, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY {by} ORDER BY row) AS run FROM (
    SELECT *, CASE WHEN abs(gap - p) > greatest(gap, p) * 0.4::DOUBLE THEN 1 ELSE 0 END AS b FROM (
      SELECT *, lag(gap) OVER (PARTITION BY {by} ORDER BY row) AS p FROM (
        SELECT {by}, row, row - lag(row) OVER (PARTITION BY {by} ORDER BY row) AS gap FROM {src}) WHERE gap IS NOT NULL)))
  GROUP BY {by}, run) GROUP BY {by}
""".format(by="page_id", src="v_peak"),
)


@query("longest_regular_run", "SELECT * FROM s_regular")
def _(t):
    return layout.longest_regular_run(t("v_peak"))


view(
    "v_layout_line",
    """
SELECT block_id, word_no AS line_no, x AS x1, y + h AS y1,
       CASE WHEN word_no % 60 IN (0, 10, 20, 50) AND lang = 'fr' THEN x + 330 WHEN word_no % 10 = 4 THEN x + word_no % 7 ELSE x + w END AS x2,
       CASE WHEN word_no % 10 = 4 THEN y + h + 110 + word_no % 40 ELSE y + h + word_no % 3 END AS y2
FROM v_word
""",
)
view(
    "v_layout_component",
    """
SELECT block_id, word_no, CASE WHEN word_no % 60 = 20 THEN CAST(300 AS DOUBLE) WHEN lang = 'es' THEN CAST(50 AS DOUBLE) ELSE w END AS w,
       CASE WHEN word_no % 60 = 20 THEN CAST(5 AS DOUBLE) WHEN lang = 'de' AND word_no % 60 = 3 THEN CAST(90 AS DOUBLE) ELSE h END AS h,
       CASE WHEN lang = 'de' AND word_no % 60 = 3 THEN CAST(300000 AS DOUBLE) ELSE w * h - word_no % 7 * 10 END AS area
FROM v_word
""",
)
view(
    "v_block_peak",
    """
SELECT block_id, CASE WHEN doc_id % 2 = 0 THEN (word_no % 60 / 10) * (word_no % 60 / 10) * 20 ELSE word_no % 60 / 10 * 28 END AS row
FROM (SELECT block_id, doc_id, word_no FROM v_word) WHERE word_no % 10 = 0
""",
)
view(
    "s_density",
    """
SELECT block_id, CASE WHEN ink > 0 THEN letters / ink ELSE 0 END::DOUBLE AS density, parts, (largest / total)::DOUBLE AS largest_share FROM (
  SELECT c.block_id, sum(CASE WHEN NOT ((h <= 6 AND w >= 240) OR (w <= 6 AND h >= 100.8)) AND w <= 45 AND h <= 45 THEN area ELSE 0 END) AS letters,
    sum(CASE WHEN (h <= 6 AND w >= 240) OR (w <= 6 AND h >= 100.8) THEN 0 ELSE area END) AS ink, sum(area) AS total, max(area) AS largest,
    count(*) AS parts FROM v_layout_component c GROUP BY c.block_id)
""",
)
view(
    "s_grid",
    """
SELECT block_id, count(*) FILTER (WHERE flat AND length >= 160) >= 3
  AND count(*) FILTER (WHERE NOT flat AND abs(angle) BETWEEN 80 AND 100 AND length >= 67.2) >= 3 AS grid
FROM (SELECT *, least(abs(angle), 180 - abs(angle)) <= 10 AS flat FROM (
  SELECT block_id, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS length, degrees(atan2(y2 - y1, x2 - x1)) AS angle FROM v_layout_line)) GROUP BY block_id
""",
)
view(
    "s_block_regular",
    """
SELECT block_id, sum(n) + 1 >= 5 AND max(n) + 1 >= 5 AS regular FROM (
  SELECT block_id, run, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY block_id ORDER BY row) AS run FROM (
    SELECT *, CASE WHEN abs(gap - p) > greatest(gap, p) * 0.4::DOUBLE THEN 1 ELSE 0 END AS b FROM (
      SELECT *, lag(gap) OVER (PARTITION BY block_id ORDER BY row) AS p FROM (
        SELECT block_id, row, row - lag(row) OVER (PARTITION BY block_id ORDER BY row) AS gap FROM v_block_peak) WHERE gap IS NOT NULL)))
  GROUP BY block_id, run) GROUP BY block_id
""",
)


@query(
    "text_density",
    f"SELECT block_id, {r('density', 6)} AS density, parts, {r('largest_share', 6)} AS largest_share FROM s_density",
)
def _(t):
    out = layout.text_density(t("v_layout_component"), t("v_block"))
    return out.withColumns({c: F.round(c, 6) for c in ("density", "largest_share")})


@query("grid_test", "SELECT block_id, grid FROM s_grid")
def _(t):
    return layout.is_grid(t("v_layout_line"), t("v_block"))


@query(
    "classify_blocks",
    """SELECT b.block_id, CASE WHEN grid THEN 'TABLE' WHEN density >= 0.15 OR coalesce(regular, false) THEN 'TEXT'
         WHEN largest_share < 0.5 AND parts >= 3 THEN 'EQUATION' ELSE 'DIAGRAM' END AS content_type
       FROM v_block b LEFT JOIN s_grid g ON g.block_id = b.block_id LEFT JOIN s_density d ON d.block_id = b.block_id
       LEFT JOIN s_block_regular k ON k.block_id = b.block_id""",
)
def _(t):
    return layout.classify_blocks(t("v_block"), t("v_layout_component"), t("v_layout_line"), t("v_block_peak"))


view(
    "v_ocr_word",
    """
SELECT block_id, word_no, CASE WHEN word_no % 9 = 4 OR doc_id % 20 = 6 THEN '  ' ELSE concat(' ', text) END AS text,
       CAST((word_no * 13 + doc_id) % 107 - 6 AS DOUBLE) AS conf FROM v_word
""",
)
view(
    "s_ocr",
    f"""
SELECT block_id, coalesce(string_agg(trim(text), ' ' ORDER BY word_no) FILTER (WHERE conf >= 0 AND trim(text) <> ''), '') AS text,
  coalesce({r("avg(conf) FILTER (WHERE conf >= 0 AND trim(text) <> '') / 100")}, 0) AS confidence FROM v_ocr_word GROUP BY block_id
""",
)


@query("ocr_blocks", "SELECT * FROM s_ocr")
def _(t):
    return layout.ocr_blocks(t("v_ocr_word"))


view(
    "v_block_metric",
    """
SELECT block_id, CAST(block_id % 331 AS DOUBLE) AS sharpness, CAST(block_id % 29 AS DOUBLE) AS contrast,
       CAST(block_id % 101 AS DOUBLE) / 100 AS ocr_confidence FROM v_block
""",
)
QUALITY = r("0.6::DOUBLE * least(sharpness / 250, 1) + 0.4::DOUBLE * least(contrast / 20, 1)")


@query("quality_score", f"SELECT block_id, {QUALITY} AS quality FROM v_block_metric")
def _(t):
    return t("v_block_metric").select("block_id", layout.quality_score().alias("quality"))


@query(
    "route_ocr",
    f"""SELECT block_id, CASE WHEN ocr_confidence < 0.65 THEN 'VLM' WHEN {QUALITY} >= 0.6 THEN 'TESSERACT_6' ELSE 'TESSERACT_11' END AS engine
        FROM v_block_metric""",
)
def _(t):
    scored = t("v_block_metric").withColumn("quality", layout.quality_score())
    return layout.route_ocr(scored).select("block_id", "engine")

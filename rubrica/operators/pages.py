"""Page replies to answer blocks: validation, question labels, merging, crops, assembly per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rubrica.config import CONTENT_TYPES, MARK_INTENTS, MARK_KINDS
from rubrica.functions.geometry import settled
from rubrica.functions.replies import parse_reply
from rubrica.functions.text import norm_number, strip

PAGE = ["sheet_id", "page_index"]
_BOX = "x string, y string, w string, h string, width string, height string"
_BLOCK = (
    "question_number string, bbox string, content_type string, raw_text string, reconstructed_text string,"
    " confidence string, annotations string, underlined_words string"
)
_MARK = "kind string, intent string, bbox string, confidence string"


def _has(raw: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(raw), key), F.lit(False))


def _with_box(df: DataFrame, raw: str, floor: float = 0.0) -> DataFrame:
    """Append `box`, clamped into the page, null when it cannot be used.

    Parsed once, then read in further projections, so that no step parses the text again.
    """
    df = df.withColumn("_v", F.from_json(raw, _BOX)).withColumn("_k", F.json_object_keys(raw))
    named = F.coalesce(F.array_contains("_k", "w"), F.lit(False)), F.coalesce(F.array_contains("_k", "h"), F.lit(False))
    pw, ph = F.col("page_w").cast("double"), F.col("page_h").cast("double")
    numbers = {
        "_x": F.col("_v.x"),
        "_y": F.col("_v.y"),
        "_w": F.when(named[0], F.col("_v.w")).otherwise(F.col("_v.width")),
        "_h": F.when(named[1], F.col("_v.h")).otherwise(F.col("_v.height")),
    }
    df = df.withColumns({k: c.try_cast("double") for k, c in numbers.items()})
    # least and greatest skip nulls, so the whole box is tested for nulls first
    whole = F.col("_x").isNotNull() & F.col("_y").isNotNull() & F.col("_w").isNotNull() & F.col("_h").isNotNull()

    def clamp(c: str, top: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.col(c), top))

    df = df.withColumns({"_x": clamp("_x", pw), "_y": clamp("_y", ph), "_ok": whole})
    w = F.least(clamp("_w", pw), pw - F.col("_x"))
    h = F.least(clamp("_h", ph), ph - F.col("_y"))
    if floor:
        w = F.greatest(w, F.least(F.lit(floor), pw - F.col("_x")))
        h = F.greatest(h, F.least(F.lit(floor), ph - F.col("_y")))
    df = df.withColumns({"_w": w, "_h": h})
    usable = F.col("_ok") & (F.col("_w") > 0) & (F.col("_h") > 0)
    box = F.struct(*[F.col(f"_{c}").alias(c) for c in ("x", "y", "w", "h")])
    return df.withColumn("box", F.when(usable, box)).drop("_v", "_k", "_x", "_y", "_w", "_h", "_ok")


def _fraction(raw: Column) -> Column:
    n = raw.try_cast("double")
    return F.when((n >= 0) & (n <= 1), n)


def _exploded(replies: DataFrame) -> DataFrame:
    """One row per block of each reply, the page columns repeated; a reply without blocks keeps one row."""
    base = parse_reply(replies.select(*PAGE, "page_w", "page_h", "reply"), "reply", "blocks array<string>", "_p")
    return base.select(
        *PAGE, "page_w", "page_h", F.col("_p").isNull().alias("unreadable"),
        F.posexplode_outer("_p.blocks").alias("block_no", "raw"),
    )


def judge(replies: DataFrame) -> DataFrame:
    """Blocks of all replies, parsed, with `reason`, the first rule a block broke; a reply without blocks keeps one row, not `found`.

    `replies`: sheet_id, page_index, page_w, page_h, reply. Status, blocks and marks of pages are read off it, so that a job
    that needs several of them parses its replies once.
    """
    rows = _exploded(replies).withColumn("b", F.from_json("raw", _BLOCK)).withColumn("_bbox", F.col("b.bbox"))
    rows = _with_box(rows, "_bbox").drop("_bbox")
    kind = F.upper(F.coalesce("b.content_type", F.lit("")))
    marks_ok = ~_has(F.col("raw"), "annotations") | F.coalesce(F.col("b.annotations").startswith("["), F.lit(False))
    reason = (
        F.when(F.col("raw").isNull(), F.lit(None))
        .when(~kind.isin(*CONTENT_TYPES), "content_type")
        .when(~marks_ok, "annotations")
        .when(F.col("box").isNull(), "bbox")
        .when(_fraction(F.col("b.confidence")).isNull(), "confidence")
    )
    rows = rows.withColumns({"content_type": kind, "reason": reason, "found": F.col("raw").isNotNull(), "confidence": _fraction(F.col("b.confidence"))})
    texts = [F.col(f"b.{c}") for c in ("question_number", "raw_text", "reconstructed_text", "annotations", "underlined_words")]
    rows = rows.select(*PAGE, "page_w", "page_h", "block_no", "unreadable", "found", "reason", "content_type", "box", "confidence", *texts)
    # settled, or the filters of the callers would parse a block's whole text again for each condition of theirs
    return settled(rows)


def _good(judged: DataFrame) -> DataFrame:
    return judged.where("found AND reason IS NULL")


def page_blocks(replies: DataFrame) -> DataFrame:
    """Valid blocks. `replies`: sheet_id, page_index, page_w, page_h, reply.

    Text and table boxes take the whole page width; the model's own sideways estimate cuts lines off.
    """
    return blocks_of(judge(replies))


def blocks_of(judged: DataFrame) -> DataFrame:
    """`page_blocks` from the blocks of `judge`."""
    wide = F.col("content_type").isin("TEXT", "TABLE")
    words = F.filter(
        F.transform(F.from_json(F.coalesce("underlined_words", F.lit("[]")), "array<string>"), strip), lambda s: s != ""
    )
    return _good(judged).select(
        *PAGE,
        "page_w",
        "page_h",
        "block_no",
        strip("question_number").alias("question_number"),
        F.when(wide, F.lit(0.0)).otherwise(F.col("box.x")).alias("x"),
        F.col("box.y").alias("y"),
        F.when(wide, F.col("page_w").cast("double")).otherwise(F.col("box.w")).alias("w"),
        F.col("box.h").alias("h"),
        "content_type",
        F.coalesce("raw_text", F.lit("")).alias("raw_text"),
        F.coalesce("reconstructed_text", F.lit("")).alias("reconstructed_text"),
        "confidence",
        words.alias("underlined_words"),
    )


def page_rejects(replies: DataFrame) -> DataFrame:
    """Blocks that were dropped, with the first rule they broke."""
    return judge(replies).where("reason IS NOT NULL").select(*PAGE, "block_no", "reason")


def page_status(replies: DataFrame) -> DataFrame:
    """One row per page: good and bad blocks, mean confidence, and whether the page has to be asked for again."""
    return page_verdicts(replies).drop("reasons")


def page_verdicts(replies: DataFrame) -> DataFrame:
    """`page_status` with `reasons`, the rules that the page's blocks broke."""
    return verdicts_of(judge(replies))


def verdicts_of(judged: DataFrame) -> DataFrame:
    """`page_verdicts` from the blocks of `judge`."""
    ok = F.col("found") & F.col("reason").isNull()
    return (
        judged.groupBy(*PAGE)
        .agg(
            F.count_if(ok).alias("good"),
            F.count_if(F.col("reason").isNotNull()).alias("bad"),
            F.bool_or("unreadable").alias("unreadable"),
            F.round(F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)), 4).alias("confidence"),
            F.array_sort(F.collect_set("reason")).alias("reasons"),
        )
        .withColumn("page_ok", ~F.col("unreadable") & ~((F.col("good") == 0) & (F.col("bad") > 0)))
    )


def page_marks(replies: DataFrame) -> DataFrame:
    """Valid marks of valid blocks; one bad mark is dropped alone. Thin marks are raised to four pixels."""
    return marks_of(judge(replies))


def marks_of(judged: DataFrame) -> DataFrame:
    """`page_marks` from the blocks of `judge`."""
    items = F.from_json(F.coalesce("annotations", F.lit("[]")), "array<string>")
    rows = _good(judged).select(*PAGE, "page_w", "page_h", "block_no", F.posexplode(items).alias("mark_no", "raw_mark"))
    rows = rows.withColumn("m", F.from_json("raw_mark", _MARK)).withColumn("_bbox", F.col("m.bbox"))
    rows = _with_box(rows, "_bbox", 4.0).drop("_bbox")
    rows = rows.withColumns(
        {"kind": F.upper("m.kind"), "intent": F.upper("m.intent"), "confidence": _fraction(F.col("m.confidence"))}
    )
    return settled(rows.select(*PAGE, "block_no", "mark_no", "kind", "intent", "box", "confidence")).where(
        F.col("kind").isin(*MARK_KINDS)
        & F.col("intent").isin(*MARK_INTENTS)
        & F.col("box").isNotNull()
        & F.col("confidence").isNotNull()
    ).select(*PAGE, "block_no", "mark_no", "kind", "intent", "box.*", "confidence")


def carry_forward(blocks: DataFrame) -> DataFrame:
    """Give an unlabelled block the last label before it in its sheet: question_label, key, is_continuation.

    A sheet is at most twenty pages, which bounds the window.
    """
    own = F.nullif("question_number", F.lit(""))
    w = Window.partitionBy("sheet_id").orderBy("page_index", "block_no").rowsBetween(Window.unboundedPreceding, 0)
    labelled = blocks.withColumn("question_label", F.last(own, ignorenulls=True).over(w)).withColumn(
        "is_continuation", own.isNull()
    )
    return labelled.withColumn("key", norm_number("question_label"))


def _tiny() -> Column:
    return F.col("w") * F.col("h") < F.col("page_w") * F.col("page_h") * 0.02


def suspicious_pages(blocks: DataFrame) -> DataFrame:
    """Pages whose blocks all cover less than 2 % of the page."""
    return blocks.groupBy(*PAGE).agg(F.bool_and(_tiny()).alias("suspicious"))


def flag_suspicious(blocks: DataFrame) -> DataFrame:
    """The same flag on every block; after `carry_forward` the rows already lie together by sheet."""
    return blocks.withColumn("suspicious", F.bool_and(_tiny()).over(Window.partitionBy(*PAGE)))


def engine_of(content_type) -> Column:
    """Engine recorded for a block read by the vision model."""
    c = F.col(content_type) if isinstance(content_type, str) else content_type
    return F.when(c == "TEXT", "VLM").otherwise("VLM_SPECIALIZED")


def derive_engine(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("ocr_engine", engine_of("content_type"))


def _agg(col: str, order: str) -> Column:
    return F.expr(f"listagg({col}, ' ') WITHIN GROUP (ORDER BY {order})")


def full_page_blocks(blocks: DataFrame) -> DataFrame:
    """Per question of a page with unreliable boxes: one block of the whole page. `blocks` carry key."""
    return (
        blocks.groupBy(*PAGE, "key")
        .agg(
            F.max("page_w").alias("page_w"),
            F.max("page_h").alias("page_h"),
            F.min("block_no").alias("block_no"),
            strip(F.coalesce(_agg("reconstructed_text", "block_no"), F.lit(""))).alias("reconstructed_text"),
            strip(F.coalesce(_agg("raw_text", "block_no"), F.lit(""))).alias("raw_text"),
            F.avg("confidence").alias("confidence"),
            F.when(F.bool_and(F.col("content_type") == "TEXT"), "TEXT").otherwise("DIAGRAM").alias("content_type"),
        )
        .select(
            *PAGE, "page_w", "page_h", "key", "block_no",
            F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
            F.col("page_w").cast("double").alias("w"), F.col("page_h").cast("double").alias("h"),
            "content_type", F.lit("VLM").alias("ocr_engine"), "raw_text", "reconstructed_text", "confidence",
        )
    )


def _questions_on_page(blocks: DataFrame) -> DataFrame:
    """One row per page and question: its tops, its text parts and their underlined words joined, and `bottom`, the foot of its text.

    The foot is the nearest top of another question below the question's own text, else the foot of the page. Text tops
    count text blocks only, the other tops count every block. A page holds a few questions, so their tops travel as a
    short array over the page instead of a join of the page with itself.
    """
    is_text = F.col("content_type") == "TEXT"

    def text(c: str) -> Column:
        return F.when(is_text, F.col(c))

    def joined(c: str) -> Column:
        listed = F.expr(
            f"listagg(CASE WHEN content_type = 'TEXT' THEN nullif({c}, '') END, ' ') WITHIN GROUP (ORDER BY y, block_no)"
        )
        return strip(F.coalesce(listed, F.lit("")))

    place = F.when(is_text, F.struct("y", "block_no"))
    words = F.sort_array(F.collect_list(F.when(is_text, F.struct("y", "block_no", "underlined_words"))))
    tops = blocks.groupBy(*PAGE, "key").agg(
        F.count_if(is_text).alias("parts"),
        F.min("y").alias("top"),
        F.min(text("y")).alias("y"),
        F.min(text("x")).alias("x"),
        F.max(F.when(is_text, F.col("x") + F.col("w"))).alias("x2"),
        F.max(text("h")).alias("own_h"),
        F.max("page_w").alias("page_w"),
        F.max("page_h").alias("page_h"),
        F.min_by(text("block_no"), place).alias("block_no"),
        F.min_by(text("question_number"), place).alias("question_number"),
        F.flatten(F.transform(words, lambda p: p["underlined_words"])).alias("underlined_words"),
        joined("raw_text").alias("joined_raw"),
        joined("reconstructed_text").alias("joined_text"),
        F.max(text("raw_text")).alias("own_raw"),
        F.max(text("reconstructed_text")).alias("own_text"),
        F.avg(text("confidence")).alias("confidence"),
    )
    around = tops.withColumn("_all", F.collect_list(F.struct("key", "top")).over(Window.partitionBy(*PAGE)))
    below = F.filter("_all", lambda o: (o["key"] != F.col("key")) & (o["top"] > F.col("y")))
    bottom = F.least(F.col("page_h").cast("double"), F.array_min(F.transform(below, lambda o: o["top"])))
    return around.where("parts > 0").withColumn("bottom", bottom).drop("_all")


def next_top(blocks: DataFrame) -> DataFrame:
    """Lower bound of each question's text on a page: the next other question's top, or the foot of the page."""
    return _questions_on_page(blocks).select(*PAGE, "key", "bottom")


def merge_text_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with several text blocks of one question on a page joined into one.

    The joined box spans the parts sideways and starts at the topmost; its foot is `next_top`, since the parts' own
    heights fall short. The label is the topmost part's, and the underlined words of all parts follow in reading order;
    marks follow by `merged_parts`. Other blocks pass unchanged.
    """
    many = F.col("parts") > 1
    text = _questions_on_page(blocks).select(
        *PAGE, "page_w", "page_h", "key", "block_no", "x", "y",
        (F.col("x2") - F.col("x")).alias("w"),
        F.when(many, F.col("bottom") - F.col("y")).otherwise(F.col("own_h")).alias("h"),
        F.lit("TEXT").alias("content_type"), F.lit("VLM").alias("ocr_engine"),
        F.when(many, F.col("joined_raw")).otherwise(F.col("own_raw")).alias("raw_text"),
        F.when(many, F.col("joined_text")).otherwise(F.col("own_text")).alias("reconstructed_text"),
        "confidence", "question_number", "underlined_words",
    )
    rest = derive_engine(blocks.where("content_type <> 'TEXT'")).select(*text.columns)
    return rest.unionByName(text)


def merged_parts(blocks: DataFrame) -> DataFrame:
    """Where each block's marks and underlined words go: block_no to the block_no that holds it after merging."""
    is_text = F.col("content_type") == "TEXT"
    same = Window.partitionBy(*PAGE, "key")
    head = F.min_by("block_no", F.when(is_text, F.struct("y", "block_no"))).over(same)
    return blocks.select(*PAGE, "block_no", F.when(is_text, head).otherwise(F.col("block_no")).alias("head_no"))


def prepare_blocks(blocks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Blocks ready for grading from labelled page blocks: whole pages where boxes are unreliable, merged elsewhere.

    `only` (sheet_id, only_key) names the one question of single-question exams, whose unreliable pages are joined
    whatever the labels. `key` stands for the label; whole pages carry no underlined words.
    """
    judged = flag_suspicious(blocks)
    sane, odd = judged.where(~F.col("suspicious")), judged.where("suspicious")
    if only is not None:
        odd = odd.join(only, "sheet_id", "left").withColumn("key", F.coalesce("only_key", "key")).drop("only_key")
    return merge_text_blocks(sane).drop("question_number").unionByName(full_page_blocks(odd), allowMissingColumns=True)


def only_questions(sheets: DataFrame, questions: DataFrame) -> DataFrame:
    """Sheets of exams with one question, and its key: sheet_id, only_key."""
    single = (
        questions.groupBy("exam_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(norm_number("number")).alias("only_key"))
        .where("_n = 1")
    )
    return sheets.select("sheet_id", "exam_id").join(single.select("exam_id", "only_key"), "exam_id").drop("exam_id")


def crop_origin(blocks: DataFrame) -> DataFrame:
    """Whole-pixel crop x0, y0, x1, y1 of each block and whether it is empty."""
    x0 = F.greatest(F.lit(0), F.col("x").cast("bigint"))
    y0 = F.greatest(F.lit(0), F.col("y").cast("bigint"))
    out = blocks.withColumns(
        {
            "x0": x0,
            "y0": y0,
            "x1": F.least(F.col("page_w").cast("bigint"), (F.col("x") + F.col("w")).cast("bigint")),
            "y1": F.least(F.col("page_h").cast("bigint"), (F.col("y") + F.col("h")).cast("bigint")),
        }
    )
    return out.withColumn("empty_crop", (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")))


def to_crop_space(marks: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks in crop pixels, blocks whose crop is empty). Marks carry the block they belong to."""
    cropped = crop_origin(blocks)
    origin = cropped.where("NOT empty_crop").select(*PAGE, "block_no", "x0", "y0")
    moved = (
        marks.join(origin, [*PAGE, "block_no"])
        .withColumn("x", F.col("x") - F.col("x0"))
        .withColumn("y", F.col("y") - F.col("y0"))
        .drop("x0", "y0")
    )
    return moved, cropped.where("empty_crop").select(*PAGE, "block_no")


def block_marks(marks: DataFrame, labelled: DataFrame, assigned: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Marks of the blocks that were kept, in the pixels of their block's crop.

    `marks` are those of `page_marks`, `labelled` the blocks of `carry_forward`, `assigned` the prepared blocks with their
    question, `only` as for `prepare_blocks`. A mark goes where its block went: to the joined text block of its question, to
    the whole page where boxes are unreliable, or stays with its own block. Empty crops carry none. Returns sheet_id, exam_id,
    question_id, page_index, block_no (the block that holds the mark), part_no (the one it was read from), mark_no, the mark.
    """
    judged = flag_suspicious(labelled)
    odd = judged.where("suspicious")
    if only is not None:
        odd = odd.join(only, "sheet_id", "left").withColumn("key", F.coalesce("only_key", "key"))
    whole = F.min("block_no").over(Window.partitionBy(*PAGE, "key"))
    parts = merged_parts(judged.where("NOT suspicious")).unionByName(odd.select(*PAGE, "block_no", whole.alias("head_no")))
    moved = marks.join(parts, [*PAGE, "block_no"]).withColumnRenamed("block_no", "part_no").withColumnRenamed("head_no", "block_no")
    held = crop_origin(assigned.where("block_no IS NOT NULL")).where("NOT empty_crop")
    placed = moved.join(held.select("exam_id", "question_id", *PAGE, "block_no", "x0", "y0"), [*PAGE, "block_no"])
    return placed.select(
        "sheet_id", "exam_id", "question_id", "page_index", "block_no", "part_no", "mark_no", "kind", "intent",
        (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "w", "h", "confidence",
        F.lit("VLM").alias("resolved_by"),
    )


def question_spine(sheets: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per sheet and question of its exam, with the question's text and maximum as they are now."""
    q = questions.select(
        "exam_id", "question_id", F.col("number").alias("question_number"), norm_number("number").alias("key"), "max_marks",
        *[F.col(c).alias(f"question_{c}") for c in ("text",) if c in questions.columns],
    )
    return sheets.select("sheet_id", "exam_id").join(q, "exam_id")


def assign_blocks(sheets: DataFrame, questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Spine left-joined to its blocks. In an exam of one question every block is that question's.

    Blocks whose label names no question of the exam are dropped; questions without blocks keep one row of nulls.
    """
    keyed = (
        blocks.join(only_questions(sheets, questions), "sheet_id", "left")
        .withColumn("key", F.coalesce("only_key", "key"))
        .drop("only_key")
    )
    return question_spine(sheets, questions).join(keyed, ["sheet_id", "key"], "left")


def assemble_answers(assigned: DataFrame) -> DataFrame:
    """Text and mean quality per sheet and question: blocks in page order joined by spaces, 0 quality without blocks."""
    order = "page_index, y, CASE WHEN content_type = 'TEXT' THEN 1 ELSE 0 END, block_no"
    texts = [c for c in ("question_text",) if c in assigned.columns]
    return assigned.groupBy("sheet_id", "exam_id", "question_id", "question_number", "max_marks", *texts).agg(
        strip(F.coalesce(_agg("reconstructed_text", order), F.lit(""))).alias("text"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("ocr_quality"),
        F.count("block_no").alias("blocks"),
    )

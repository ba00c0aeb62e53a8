"""Text rules as column expressions: trimming, sentences, chunks, keywords, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.config import DEFAULTS, STOP_WORDS, WS, Thresholds


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(col) -> Column:
    """Trim every kind of white space, which the built-in trim does not."""
    return F.regexp_replace(_c(col), f"^{WS}+|{WS}+$", "")


def rstrip(col) -> Column:
    return F.regexp_replace(_c(col), f"{WS}+$", "")


def _one_for_one() -> dict[str, str]:
    """Letters whose upper case is several characters, with the one-character upper case of each."""
    several = [c for c in map(chr, range(0x80, 0x110000)) if len(c.upper()) > 1]
    return {c: "\u1e9e" if c == "\xdf" else c.title() if len(c.title()) == 1 else c for c in several}


def upper(col) -> Column:
    """Upper case letter by letter, so that a text keeps its length: the built-in `upper` turns ß into SS."""
    special = _one_for_one()
    known = F.create_map(*[F.lit(x) for pair in special.items() for x in pair])
    letters = F.transform(F.split(_c(col), ""), lambda c: F.coalesce(F.element_at(known, c), F.upper(c)))
    plain = ~_c(col).rlike("[" + "".join(special) + "]")
    return F.when(plain, F.upper(_c(col))).otherwise(F.array_join(letters, ""))


def norm_number(col) -> Column:
    """Question number reduced to lower-case letters and digits."""
    return F.regexp_replace(F.lower(F.coalesce(_c(col), F.lit(""))), "[^0-9a-z]", "")


# --- fixed values: question label patterns --------------------------------------------------------
LABEL = r"(?i)^\W*(?:Q\.?\s*)?(\d{1,2}\s*[a-e]?)[.\):]"
LABEL_LENIENT = r"(?i)^\W*(?:Q\.?\s*)?(\d{1,2}\s*[a-e]?)\W*$"


def extract_label(col, lenient: bool = False) -> Column:
    """Question label at the start of a text, null when there is none."""
    found = F.regexp_extract(_c(col), LABEL_LENIENT if lenient else LABEL, 1)
    return F.nullif(F.lower(F.regexp_replace(found, " ", "")), F.lit(""))


# --- fixed values: what makes a block look like mathematics ----------------------------------------
MATH = r"\\frac|\\sum|\\int|[A-Za-z0-9]\s*/\s*\("


def is_math(col) -> Column:
    return _c(col).rlike(MATH)


def answer_hash(col) -> Column:
    return F.sha2(strip(col), 256)


def keywords(col) -> Column:
    """Distinct lower-case words without the stop words."""
    words = F.regexp_extract_all(F.lower(_c(col)), F.lit("([a-z]+)"), 1)
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))


def keyword_overlap(a, b) -> Column:
    """Number of keywords two keyword arrays share."""
    return F.size(F.array_intersect(_c(a), _c(b)))


def keyword_verdict(concept_words, excerpt_words) -> Column:
    """Verdict from the share of a concept's keywords the excerpt holds; takes keyword arrays."""
    n = F.size(_c(concept_words))
    share = keyword_overlap(concept_words, excerpt_words) / F.when(n > 0, n)
    return F.when(share >= 0.5, "COVERED").when(share >= 0.2, "PARTIAL").otherwise("MISSING")


def _segments(col: Column, ends: str) -> Column:
    """Cut a text after each match of `ends`, keeping every character; a segment's trailing white space stays with it."""
    return F.regexp_extract_all(col, F.lit(f"(?s)(.*?{ends}{WS}+|.+)"), 1)


def sentences(col) -> Column:
    """Trimmed sentences: cut after a full stop, exclamation or question mark followed by white space."""
    cut = F.transform(_segments(strip(col), "[.!?]"), rstrip)
    return F.filter(cut, lambda s: s != "")


def _with_offsets(segments: Column, base: Column) -> Column:
    """array<struct<raw,start>> with each segment's offset in the text it was cut from."""
    zero = F.struct(base.alias("pos"), F.array().cast("array<struct<raw:string,start:int>>").alias("out"))
    return F.aggregate(
        segments,
        zero,
        lambda acc, s: F.struct(
            (acc["pos"] + F.length(s)).alias("pos"),
            F.array_append(acc["out"], F.struct(s.alias("raw"), acc["pos"].alias("start"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _glued(clauses: Column, shortest: int) -> Column:
    """Join each clause shorter than `shortest` to the one before it."""
    none = F.array().cast("array<struct<raw:string,start:int>>")

    def step(acc: Column, c: Column) -> Column:
        clause = F.regexp_replace(c["raw"], f",{WS}+$", "")
        joins = (F.size(acc) > 0) & (F.length(clause) < shortest)
        last = F.element_at(acc, -1)
        longer = F.struct(F.concat(last["raw"], c["raw"]).alias("raw"), last["start"].alias("start"))
        return F.when(joins, F.array_append(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(F.array_append(acc, c))

    return F.aggregate(clauses, none, step)


def chunks(col, t: Thresholds = DEFAULTS) -> Column:
    """array<struct<raw,start>> of an answer's chunks: sentences, the long ones cut at commas."""

    def pieces(s: Column) -> Column:
        sentence = rstrip(s["raw"])
        cut = _glued(_with_offsets(_segments(sentence, ","), s["start"]), t.short_clause)
        whole = F.array(F.struct(sentence.alias("raw"), s["start"].alias("start")))
        return F.when(F.length(sentence) > t.long_sentence, cut).otherwise(whole)

    return F.flatten(F.transform(_with_offsets(_segments(strip(col), "[.!?]"), F.lit(0)), pieces))


def chunk_text(df: DataFrame, text_col: str, keep: list[str], t: Thresholds = DEFAULTS) -> DataFrame:
    """One row per chunk: `keep` columns, chunk_no, text, start and end in the trimmed text.

    The cutting happens inside the row, so no shuffle is needed to number chunks or to find offsets.
    """
    return (
        df.select(*keep, F.posexplode(chunks(text_col, t)).alias("chunk_no", "c"))
        .select(*keep, "chunk_no", rstrip("c.raw").alias("text"), F.col("c.start").alias("start"))
        .where(F.col("text") != "")
        .withColumn("end", F.col("start") + F.length("text"))
    )


def tag_spans(chunk_rows: DataFrame, spans_col: str = "spans") -> DataFrame:
    """Mark chunks that overlap one of the answer's underlined spans array<struct<s,e>>."""
    hit = F.exists(spans_col, lambda p: (F.col("start") < p["e"]) & (p["s"] < F.col("end")))
    return chunk_rows.withColumn("underlined", F.coalesce(hit, F.lit(False)))

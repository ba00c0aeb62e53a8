"""Model replies: repair, parsing, verdicts, feedback, error texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.config import OVERLOAD_MESSAGE, OVERLOAD_PATTERN
from rubrica.functions.text import strip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def object_text(col) -> Column:
    """The part of a reply from its first to its last brace, null when there is none.

    An object inside a code fence or amid prose is found the same way as a bare one.
    """
    c = _c(col)
    first = F.instr(c, "{")
    last = F.length(c) - F.instr(F.reverse(c), "}") + 1
    return F.when((first > 0) & (last > first) & (F.instr(c, "}") > 0), F.substring(c, first, last - first + 1))


def _parsed(text: Column, schema: str) -> Column:
    return F.from_json(text, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})


def parsed_reply(col, schema: str) -> Column:
    """Reply as a struct, null when it holds no readable object; single-quoted keys and texts are read too.

    Declare fields as string to accept any kind of value; nested values then come back as their JSON text.
    """
    parsed = _parsed(object_text(col), schema)
    return F.when(parsed["_bad"].isNull(), parsed)


def parse_reply(df: DataFrame, col: str, schema: str, out: str = "parsed") -> DataFrame:
    """Append the parsed reply; staged, so that a long reply is searched and parsed once."""
    staged = df.withColumn("_text", object_text(col)).withColumn("_read", _parsed(F.col("_text"), schema))
    return staged.withColumn(out, F.when(F.col("_read._bad").isNull(), F.col("_read"))).drop("_text", "_read")


VERDICT = r"\b(COVERED|PARTIAL|MISSING)\b"


def verdict_of(col) -> Column:
    """First verdict word of the reply's field; an unreadable reply is scanned whole; MISSING when there is none."""
    parsed = parsed_reply(col, "verdict string")
    source = F.when(parsed.isNotNull(), F.coalesce(parsed["verdict"], F.lit(""))).otherwise(_c(col))
    return F.coalesce(F.nullif(F.regexp_extract(F.upper(source), VERDICT, 1), F.lit("")), F.lit("MISSING"))


def extract_verdict(replies: DataFrame, col: str = "reply") -> DataFrame:
    return replies.withColumn("verdict", verdict_of(col))


def parse_feedback(replies: DataFrame, col: str = "reply") -> DataFrame:
    """Append the three trimmed feedback texts, blank where the reply cannot be read."""
    fields = ("strengths", "gaps", "suggestions")
    parsed = replies.withColumn("_p", parsed_reply(col, ", ".join(f"{f} string" for f in fields)))
    return parsed.withColumns({f: F.coalesce(strip(F.col("_p")[f]), F.lit("")) for f in fields}).drop("_p")


def parse_concepts(replies: DataFrame, key: str, col: str = "reply") -> DataFrame:
    """Concepts of extraction replies: key, ord, text, weight; an unusable weight counts as 0."""
    lists = replies.withColumn("_p", parsed_reply(col, "concepts array<struct<text:string,weight:string>>"))
    return lists.select(key, F.posexplode("_p.concepts").alias("ord", "c")).select(
        key,
        "ord",
        F.coalesce("c.text", F.lit("")).alias("text"),
        F.coalesce(F.col("c.weight").try_cast("double"), F.lit(0.0)).alias("weight"),
    )


def classify_error(col) -> Column:
    """Message shown for a failed run."""
    overloaded = F.lower(_c(col)).rlike(OVERLOAD_PATTERN)
    return F.when(overloaded, OVERLOAD_MESSAGE).otherwise(F.concat(F.lit("Evaluation failed: "), _c(col)))

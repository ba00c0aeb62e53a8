"""Text sources: roster CSV, similarity pairs, question documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rubrica.config import ROSTER_ALIASES
from rubrica.functions.text import strip

# A comma with an even number of quotes after it stands between cells.
_BETWEEN_CELLS = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _cells(line: Column) -> Column:
    """Trimmed cells of a CSV line, as many as it has; quoted cells lose their quotes and doubled quotes become one."""
    quoted = r'^"([\s\S]*)"$'
    plain = lambda c: F.when(c.rlike(quoted), F.regexp_replace(F.regexp_extract(c, quoted, 1), '""', '"')).otherwise(c)
    return F.transform(F.split(line, _BETWEEN_CELLS, -1), lambda c: strip(plain(strip(c))))


def roster_rows(files: DataFrame) -> DataFrame:
    """Rows of roster files: file, row_no, usn, name, email.

    `files`: file, value (a class list as one text). A first line with two or more known headings names the columns;
    otherwise they are usn, name, email by position. Blank lines do not count as rows.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: strip(s) != "")
    rows = files.select("file", lines.alias("_lines")).where(F.size("_lines") > 0)
    alias = F.create_map(*[F.lit(x) for pair in ROSTER_ALIASES.items() for x in pair])
    head = F.transform(_cells(F.col("_lines")[0]), lambda h: strip(F.regexp_replace(F.lower(h), "[_-]+", " ")))
    rows = rows.withColumn("_head", F.transform(head, lambda h: F.try_element_at(alias, h)))
    rows = rows.withColumn("_has", F.size(F.filter("_head", lambda h: h.isNotNull())) >= 2)
    default = F.array(F.lit("usn"), F.lit("name"), F.lit("email"))
    rows = rows.withColumn("_head", F.when(F.col("_has"), F.col("_head")).otherwise(default))
    # a heading that occurs twice takes the later column
    def column_of(field: str) -> Column:
        return F.array_max(F.transform("_head", lambda h, i: F.when(h == field, i)))

    at = {field: column_of(field) for field in ("usn", "name", "email")}
    body = F.when(F.col("_has"), F.slice("_lines", 2, F.size("_lines"))).otherwise(F.col("_lines"))
    out = rows.select("file", *[c.alias(f"_{f}") for f, c in at.items()], F.posexplode(body).alias("_i", "_line"))
    out = out.withColumn("_cells", _cells(F.col("_line")))
    pick = {f: F.coalesce(F.get("_cells", F.col(f"_{f}")), F.lit("")).alias(f) for f in at}
    return out.select("file", (F.col("_i") + 1).alias("row_no"), *pick.values())


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Roster files under `path`, one class list per file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return roster_rows(files.select(F.col("_metadata.file_path").alias("file"), "value"))


def read_pairs(spark: SparkSession, path: str, heading: bool = True) -> DataFrame:
    """All similarity pairs of tab-separated files: text1, text2, human (score / 5). `heading`: each file starts with one."""
    cols = ", ".join(f"c{i} string" for i in range(10))
    raw = spark.read.csv(path, sep="\t", quote="", escape="", header=heading, schema=cols)
    return raw.select(
        F.col("c7").alias("text1"), F.col("c8").alias("text2"), (F.col("c9").cast("double") / 5).alias("human")
    )


def extract_test_cases(docs: DataFrame) -> DataFrame:
    """Questions and model answers from documents: doc, case_no, title, question, model_answer.

    `docs`: doc, value. A case starts at a level-two heading "Test "; its texts are the fenced blocks under the
    headings for question and model answer. A case that lacks either is left out.
    """
    block = rf"(?s)### {{}}\n\n```text\n(.*?)\n```"
    section = F.col("section")
    question = F.regexp_extract(section, block.format("Questions?"), 1)
    answer = F.regexp_extract(section, block.format("Model Answer"), 1)
    cases = docs.select("doc", F.posexplode(F.split("value", "\n## Test ")).alias("case_no", "section")).where(
        "case_no > 0"
    )
    has = section.rlike(block.format("Questions?")) & section.rlike(block.format("Model Answer"))
    return cases.where(has).select(
        "doc",
        "case_no",
        strip(F.regexp_extract(section, r"^([^\n]*)", 1)).alias("title"),
        strip(question).alias("question"),
        strip(answer).alias("model_answer"),
    )


def read_test_cases(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return extract_test_cases(files.select(F.col("_metadata.file_path").alias("doc"), "value"))


__all__ = ["extract_test_cases", "read_pairs", "read_roster", "read_test_cases", "roster_rows"]

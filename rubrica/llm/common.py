"""What the operators share: the word pattern, reading of tables, a per-table row count."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rubrica.session import ship_code

#: A word is a longest run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: Texts of a batch meet Python together; few rows keep a batch of very long texts small.
BATCH_ROWS = "500"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library at its workers and batches of a bounded number of rows."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator reads, under its own names; whatever else the table carries cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key60(seed: str, value: Column) -> Column:
    """A uniform 60-bit number from a seed and a value's text, the same in every engine that has MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")

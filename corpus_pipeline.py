"""The training-corpus pipeline: quality, near duplicates, secrets, mixing, packing, each over all that the one before kept."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from rubrica.llm import jaccard, mixing, packing, quality, secrets  # noqa: E402
from rubrica.llm.common import prepared  # noqa: E402
from rubrica.llm.queries import TOKENIZER  # noqa: E402
from rubrica.session import shared_dir  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text fails the base or whose posterior says bad go, each on its own.

    Null and empty texts fail the base. Of rows that repeat an id only the bad ones go. Texts are read whole, whatever their
    length. An empty table stays empty. Columns beyond those of documents are left out here and in every stage but the last.
    """
    prepared(spark)
    return quality.good_documents(docs.select(*COLUMNS))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest id stays.

    Null, empty and wordless texts link with nothing and stay, as do rows with a null id; rows that repeat the id that stays,
    stay with it. Texts of any length are compared whole. An empty table stays empty.
    """
    prepared(spark)
    return jaccard.one_of_each(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets in their texts are covered, and n_chars follows where one was.

    Null texts stay null. Repeated rows are treated alike. Texts are scanned whole. An empty table stays empty.
    """
    prepared(spark)
    found = secrets.scan_secrets(docs.select(*COLUMNS))
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col("secret_spans")))
    changed = F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, by shard in shuffled order; a document at its source's edge is cut after the words taken.

    Documents without words, null texts among them, add nothing and give no row. A null source is one more source, the last.
    Repeated rows are mixed each, null ids too. An empty table stays empty.
    """
    prepared(spark)
    mixed = mixing.mixed_documents(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
    return mixed.repartitionByRange("shard", "shard_order").sortWithinPartitions("shard", "shard_order").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, all rows packed whole.

    A null or empty text is its end token. Repeated rows and null ids are documents each. An empty table gives no pieces.
    """
    prepared(spark)
    return packing.pack_digest(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: Posteriors, similarity links and token ids have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The operators' registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from rubrica.llm import (
    centroids,
    cover_tree,
    jaccard,
    language,
    lm_score,
    mixing,
    packing,
    personal,
    quality,
    secrets,
    tool_calls,
    vector_codes,
    warc,
)
from rubrica.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": lambda spark, sf_dir: lm_score.scored(table(spark, sf_dir, "documents")),
    "op2_warc": lambda spark, sf_dir: warc.archive_digest(table(spark, sf_dir, "pages")),
    "op3_top_k": lambda spark, sf_dir: cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0),
    "op4_quality_rules": lambda spark, sf_dir: quality.quality_digest(table(spark, sf_dir, "documents")),
    "op5_secret_scan": lambda spark, sf_dir: secrets.secret_digest(table(spark, sf_dir, "documents")),
    "op6_mix_sources": lambda spark, sf_dir: mixing.mix_digest(table(spark, sf_dir, "documents")),
    "op7_language": lambda spark, sf_dir: language.language_digest(table(spark, sf_dir, "documents")),
    "op8_jaccard_join": lambda spark, sf_dir: jaccard.jaccard_digest(table(spark, sf_dir, "documents")),
    "op9_pack": lambda spark, sf_dir: packing.pack_digest(table(spark, sf_dir, "documents"), TOKENIZER),
}
QUERIES["op10_tool_calls"] = lambda spark, sf_dir: tool_calls.chat_digest(table(spark, sf_dir, "conversations"))
#: op1_lm_score's SQL has bigrams; with longer contexts it is held against counting alone.
QUERIES["op1_lm_score_trigrams"] = lambda spark, sf_dir: lm_score.scored(table(spark, sf_dir, "documents"), order=3)
QUERIES["op11_vector_codes"] = lambda spark, sf_dir: vector_codes.code_digest(table(spark, sf_dir, "embeddings"))
QUERIES["op12_personal_data"] = lambda spark, sf_dir: personal.personal_digest(table(spark, sf_dir, "documents"))
QUERIES["op13_centroids"] = lambda spark, sf_dir: centroids.cluster_digest(table(spark, sf_dir, "embeddings"))
ORACLES: dict[str, str] = {
    "op1_lm_score": lm_score.SCORE_SQL,
    "op2_warc": warc.DIGEST_SQL,
    "op6_mix_sources": mixing.DIGEST_SQL,
    "op11_vector_codes": vector_codes.DIGEST_SQL,
    "op13_centroids": centroids.DIGEST_SQL,
}

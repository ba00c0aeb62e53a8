"""Concept index: model answers to weighted, embedded concepts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from rubrica.functions.replies import parse_concepts
from rubrica.functions.vectors import hash_embed
from rubrica.inference.calls import call_embed, call_with_repair, split_rejects
from rubrica.inference.prompts import with_prompt
from rubrica.operators.rubric import normalise_weights, questions_to_reindex, sentence_concepts


def _has_concepts(value: dict) -> None:
    if not isinstance(value.get("concepts"), list) or not value["concepts"]:
        raise ValueError("reply holds no concepts")


def index_questions(
    new: DataFrame,
    old: DataFrame,
    make_model: Callable | None = None,
    make_embedder: Callable | None = None,
    embed: Callable = hash_embed,
) -> tuple[DataFrame, DataFrame]:
    """(concepts of questions whose answer changed, rejected questions).

    `new`: question_id, question, model_answer; `old`: question_id, model_answer_hash. Without a model the first
    sentences of the model answer are its concepts. Without an embedder `embed(df, text_col)` appends `embedding`.
    """
    changed = questions_to_reindex(new, old)
    if make_model is None:
        raw = sentence_concepts(changed, "question_id", "model_answer")
        rejects = changed.select("question_id", F.lit(None).cast("string").alias("reason")).where("reason IS NOT NULL")
    else:
        asked = with_prompt(changed, "concepts").select("question_id", "prompt")
        good, bad = split_rejects(call_with_repair(asked, "prompt", make_model, _has_concepts))
        raw = parse_concepts(good, "question_id")
        rejects = bad.select("question_id", F.col("error").alias("reason"))
    weighted = normalise_weights(raw, "question_id")
    embedded = call_embed(weighted, "text", make_embedder) if make_embedder else embed(weighted, "text")
    # the order is dense again after blank concepts were dropped
    return embedded, rejects

"""Prompts as columns. The tags and the JSON shape asked for are what the reply parsers rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.config import EMPTY_EXCERPT, DEFAULTS
from rubrica.functions.text import strip


def concept_prompt(question: Column, model_answer: Column, cap: int = DEFAULTS.concept_cap) -> Column:
    """Ask for the gradable concepts of a model answer."""
    return F.concat(
        F.lit("Question: "), strip(question),
        F.lit(f"\n\nList up to {cap} facts of the model answer that can each be graded alone, with a weight per fact;"
              " the weights sum to 1. A one-phrase answer is one fact.\n"
              'Answer as JSON: {"concepts": [{"text": "...", "weight": 0.5}]}\n\n<model_answer>\n'),
        strip(model_answer), F.lit("\n</model_answer>"),
    )


def coverage_prompt(concept: Column, excerpt: Column) -> Column:
    """Ask whether an excerpt covers a concept; a blank excerpt is said to be so."""
    shown = F.coalesce(F.nullif(strip(F.coalesce(excerpt, F.lit(""))), F.lit("")), F.lit(EMPTY_EXCERPT))
    return F.concat(
        F.lit("<concept>\n"), strip(concept), F.lit("\n</concept>\n\n<excerpt>\n"), shown,
        F.lit("\n</excerpt>\n\nIs this concept's own topic discussed? If not: MISSING. If fully and correctly: COVERED."
              ' Otherwise: PARTIAL.\nAnswer as JSON: {"verdict": "COVERED" | "PARTIAL" | "MISSING"}'),
    )


# Sent with every page image; the reply is what `operators.pages` validates.
PAGE_PROMPT = (
    "Transcribe this page of a handwritten answer sheet. Answer as JSON alone:\n"
    '{"blocks": [{"question_number": "1a" or null, "bbox": {"x": 0, "y": 0, "w": 0, "h": 0}, '
    '"content_type": "TEXT" | "DIAGRAM" | "TABLE" | "EQUATION", "raw_text": "...", "reconstructed_text": "...", '
    '"confidence": 0.0, "annotations": [{"kind": "STRIKE" | "UNDERLINE" | "ARROW" | "MARGIN", '
    '"intent": "CORRECTION" | "EMPHASIS" | "INSERTION", "bbox": {...}, "confidence": 0.0}], "underlined_words": []}]}\n'
    "One block per answer region in reading order, in page pixels from the top left. Crossed-out words stay in raw_text"
    " and leave reconstructed_text."
)


def feedback_prompts(scores: DataFrame, by: list[str]) -> DataFrame:
    """One prompt per answer: a line for each concept with its status before it, in rubric order."""
    line = "concat('(', lower(status), ') ', concept_text)"
    graded = scores.groupBy(*by).agg(F.expr(f"listagg({line}, '\n') WITHIN GROUP (ORDER BY ord)").alias("_lines"))
    task = (
        "\n\nTell them what went well, what is lacking and what to read again. Answer as JSON: "
        '{"strengths": "...", "gaps": "...", "suggestions": "..."}'
    )
    head = "A student's answer was graded fact by fact.\n\n"
    return graded.select(*by, F.concat(F.lit(head), F.col("_lines"), F.lit(task)).alias("prompt"))


def with_prompt(df: DataFrame, kind: str) -> DataFrame:
    """Append `prompt`: kind "concepts" needs question, model_answer; "coverage" needs concept_text, evidence; "page" nothing."""
    if kind == "page":
        return df.withColumn("prompt", F.lit(PAGE_PROMPT))
    if kind == "concepts":
        return df.withColumn("prompt", concept_prompt(F.col("question"), F.col("model_answer")))
    if kind == "coverage":
        return df.withColumn("prompt", coverage_prompt(F.col("concept_text"), F.col("evidence")))
    raise ValueError(f"no prompt of kind {kind!r}")

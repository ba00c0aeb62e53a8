"""Rubric concepts: extraction from model answers, order, weights, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rubrica.config import DEFAULTS, Thresholds
from rubrica.functions.text import answer_hash, sentences, strip


def sentence_concepts(df: DataFrame, key: str, text_col: str, cap: int = DEFAULTS.concept_cap) -> DataFrame:
    """First sentences of a model answer as concepts of equal weight; the whole text when it has none."""
    found = F.slice(sentences(text_col), 1, cap)
    listed = F.when(F.size(found) > 0, found).otherwise(F.array(strip(text_col)))
    return (
        df.select(key, listed.alias("_l"))
        .select(key, F.size("_l").alias("_n"), F.posexplode("_l").alias("ord", "text"))
        .select(key, "ord", "text", F.round(F.lit(1.0) / F.col("_n"), 6).alias("weight"))
    )


def concept_order(concepts: DataFrame, key: str, order: str, cap: int = DEFAULTS.concept_cap) -> DataFrame:
    """Number concepts 0.. per question and keep the first `cap`; the rank filter drops rows before the shuffle."""
    w = Window.partitionBy(key).orderBy(order)
    ranked = concepts.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap)
    return ranked.withColumn("ord", F.col("_rank") - 1).drop("_rank")


def normalise_weights(concepts: DataFrame, key: str, cap: int = DEFAULTS.concept_cap) -> DataFrame:
    """Keep the first `cap` concepts, drop blank texts and weights that are not positive, scale the rest to sum 1.

    Weights are rounded to six places; the last concept takes what rounding left over. Works on decimals, so the sum
    is exact. Concepts are cut to the cap first, so a window never holds more than `cap` rows of a question.
    """
    kept = (
        concepts.where(F.col("ord") < cap)
        .withColumn("text", strip("text"))
        .where((F.col("text") != "") & (F.col("weight") > 0))
    )
    w = Window.partitionBy(key)
    scaled = kept.withColumn("_t", F.sum(F.col("weight").cast("decimal(18,6)")).over(w)).withColumn(
        "_w", F.round(F.col("weight") / F.col("_t").cast("double"), 6).cast("decimal(18,6)")
    )
    drift = F.lit(1).cast("decimal(18,6)") - F.sum("_w").over(w)
    is_last = F.col("ord") == F.max("ord").over(w)
    return scaled.withColumn(
        "weight", (F.col("_w") + F.when(is_last, drift).otherwise(F.lit(0).cast("decimal(18,6)"))).cast("double")
    ).drop("_t", "_w")


def weight_check(concepts: DataFrame, key: str, t: Thresholds = DEFAULTS) -> DataFrame:
    """Weight total per question and whether it is 1 within the tolerance."""
    total = F.sum(F.col("weight").cast("decimal(18,6)")).cast("double")
    return concepts.groupBy(key).agg(total.alias("weight_sum")).withColumn(
        "weights_ok", F.abs(F.col("weight_sum") - 1) <= t.weight_tolerance
    )


def questions_to_reindex(new: DataFrame, old: DataFrame) -> DataFrame:
    """Questions whose trimmed model answer changed, or that were never indexed.

    `new`: question_id, model_answer; `old`: question_id, model_answer_hash.
    """
    hashed = new.withColumn("model_answer_hash", answer_hash("model_answer"))
    stored = old.select("question_id", F.col("model_answer_hash").alias("_old"))
    return hashed.join(stored, "question_id", "left").where(~F.col("_old").eqNullSafe(F.col("model_answer_hash"))).drop(
        "_old"
    )


def stale_concepts(concepts: DataFrame, reindexed: DataFrame) -> DataFrame:
    """Concepts a re-index deletes."""
    return concepts.join(reindexed.select("question_id"), "question_id", "left_semi")


def duplicate_numbers(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Questions whose number another question of the same exam already has; a question never clashes with itself."""
    taken = existing.select("exam_id", "number", F.col("question_id").alias("_other")).distinct()
    holders = taken.groupBy("exam_id", "number").agg(
        F.min("_other").alias("_lo"), F.max("_other").alias("_hi")
    )
    clash: Column = (F.col("_lo") != F.col("question_id")) | (F.col("_hi") != F.col("question_id"))
    return new.join(holders, ["exam_id", "number"]).where(clash).drop("_lo", "_hi")

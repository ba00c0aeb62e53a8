"""Calibration of the similarity thresholds against human labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rubrica.config import DEFAULTS
from rubrica.functions.vectors import cosine, hash_embed


def pair_similarity(pairs: DataFrame, embed=None) -> DataFrame:
    """Append `similarity` of text1 and text2 on the [0, 1] scale."""
    embed = embed or (lambda df, col, out: hash_embed(df, col, out=out))
    both = embed(embed(pairs, "text1", "_a"), "text2", "_b")
    return both.withColumn("similarity", (cosine("_a", "_b") + 1) / 2).drop("_a", "_b")


def calibrate(
    pairs: DataFrame, thresholds=(DEFAULTS.full_credit, DEFAULTS.partial_credit), by: list[str] | None = None
) -> DataFrame:
    """Report over `similarity` and `human`: n, Pearson r, and per threshold the counts and mean label on either side.

    One row per threshold, from a single pass of map-side aggregates.
    """
    s, h = F.col("similarity"), F.col("human")
    spread = F.stddev_pop(s) * F.stddev_pop(h)
    # null where either side is constant, for which the built-in raises in ANSI mode
    pearson = F.covar_pop(s, h) / F.when(spread > 0, spread)
    aggs = [F.count(F.lit(1)).alias("n"), F.round(pearson, 4).alias("pearson_r")]
    for i, cut in enumerate(thresholds):
        aggs.append(
            F.struct(
                F.lit(float(cut)).alias("threshold"),
                F.count_if(s >= cut).alias("above"),
                F.round(F.avg(F.when(s >= cut, h)), 4).alias("mean_above"),
                F.count_if(s < cut).alias("below"),
                F.round(F.avg(F.when(s < cut, h)), 4).alias("mean_below"),
            ).alias(f"_{i}")
        )
    by = by or []
    wide = pairs.groupBy(*by).agg(*aggs)
    return wide.select(*by, "n", "pearson_r", F.inline(F.array(*[F.col(f"_{i}") for i in range(len(thresholds))])))

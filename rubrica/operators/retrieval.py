"""Similarity join, top-k retrieval and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rubrica.config import DEFAULTS
from rubrica.functions.vectors import cosine_of, dot, norm


def similarity_join(queries: DataFrame, cands: DataFrame, on: list[str]) -> DataFrame:
    """Exhaustive cosine of each query vector with the candidates of the same key.

    `queries` (concepts) hold at most a rubric's few rows per key, so the result grows with the candidates. No hint is
    given: a small rubric table is broadcast by its measured size; a large one is sort-merged and AQE splits hot keys.
    Norms are computed once per row before the join. Vectors may have any length; two that meet with unequal ones raise.
    """
    q = queries.withColumn("_qn", norm("q_vec"))
    c = cands.withColumn("_cn", norm("c_vec"))
    raw = cosine_of(dot("q_vec", "c_vec"), F.col("_qn"), F.col("_cn"))
    fits = F.size("q_vec") == F.size("c_vec")
    checked = F.when(fits, raw).otherwise(F.raise_error(F.lit("vectors of unequal length")).cast("double"))
    return q.join(c, on).withColumn("raw", checked).drop("_qn", "_cn", "q_vec", "c_vec")


def top_k(scored: DataFrame, by: list[str], k: int = DEFAULTS.top_k, value: str = "raw", tie: str = "chunk_no"):
    """Best k per group, ties in input order; the rank filter lets each task drop rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def majority_vote(votes: DataFrame, by: list[str]) -> DataFrame:
    """Most frequent verdict, ties to the one seen first; `votes`: by..., pass_no, verdict.

    Two map-side aggregations: counts per verdict, then the best of at most three rows. A hot key costs nothing extra.
    """
    tally = votes.groupBy(*by, "verdict").agg(F.count(F.lit(1)).alias("n"), F.min("pass_no").alias("first"))
    return (
        tally.groupBy(*by)
        .agg(
            F.max_by("verdict", F.struct("n", -F.col("first"))).alias("verdict"),
            F.max("n").alias("top"),
            F.sum("n").alias("passes"),
        )
        .withColumn("agreement", F.round(F.col("top").cast("double") / F.col("passes"), 4))
        .withColumn("disagreed", F.col("agreement") < 1.0)
        .drop("top")
    )


def pass_audit(votes: DataFrame, by: list[str]) -> DataFrame:
    """Passes and distinct verdicts per concept."""
    tally = votes.groupBy(*by, "verdict").agg(F.count(F.lit(1)).alias("n"))
    return tally.groupBy(*by).agg(
        F.sum("n").alias("passes"),
        F.count(F.lit(1)).alias("distinct_verdicts"),
        *[F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)).alias(v.lower())
          for v in ("COVERED", "PARTIAL", "MISSING")],
    )


def fan_out(df: DataFrame, passes: int) -> DataFrame:
    """One row per independent pass, numbered from 1."""
    return df.withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.lit(passes))))


def batch_no(df: DataFrame, by: list[str], order: str, bucket: str, size: int = 100) -> DataFrame:
    """Number rows 0.. in order within `by` and cut them into batches of `size`.

    Rows are numbered inside (by, bucket) and shifted by the sizes of the earlier buckets, so that a key holding most
    of the table is numbered by many tasks. `bucket` is a column that rises with `order`.
    """
    local = F.row_number().over(Window.partitionBy(*by, bucket).orderBy(order))
    sizes = df.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sizes.withColumn("_before", before).drop("_n")
    return (
        df.withColumn("_local", local)
        .join(offsets, [*by, bucket])
        .withColumn("row_no", F.col("_before") + F.col("_local") - 1)
        .withColumn("batch_no", F.floor(F.col("row_no") / size))
        .drop("_local", "_before")
    )

"""Pages to replies: each page is asked for until its reply can be used, at most a few times.

Attempts are rows of a stored work table, a folder per attempt. An attempt asks only for the pages whose reply the one before
could not be used, with what was wrong in the prompt. Answers lie in files as soon as their task ends, so a lost executor
takes the answers of the tasks it was running and no others, and a job that is started again goes on with the first attempt
that is not complete.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.inference.calls import call_image
from rubrica.inference.prompts import PAGE_PROMPT
from rubrica.operators.pages import PAGE, page_verdicts
from rubrica.sources.sinks import table_exists

TASKS_A_CORE = 32  # an attempt has at most so many tasks for each core; of a large table each asks for more pages then
KEPT = (*PAGE, "page_w", "page_h", "reply", "error", "final", "latency_ms")


def retry_prompt(attempt: int, attempts: int, error) -> F.Column:
    """The page prompt with what was wrong with the reply before."""
    told = F.concat(F.lit(f"\nAttempt {attempt} of {attempts}. The reply before was no use: "), error, F.lit(". Send the JSON object alone."))
    return F.concat(F.lit(PAGE_PROMPT), told)


@contextmanager
def _images_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches for Python hold at most `rows` rows meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def judged(called: DataFrame) -> DataFrame:
    """Replies with `error`, null where the page can be used, and `final`: a call that raised is not repeated."""
    status = page_verdicts(called.where("error IS NULL")).select(*PAGE, "page_ok", "unreadable", "reasons")
    wrong = F.when(F.col("unreadable"), "it holds no JSON object").otherwise(F.concat(F.lit("no block is valid: "), F.array_join("reasons", ", ")))
    out = called.withColumnRenamed("error", "_raised").join(status, list(PAGE), "left")
    error = F.when(F.col("_raised").isNotNull(), F.col("_raised")).when(~F.col("page_ok"), wrong)
    return out.withColumn("error", error).withColumn("final", F.col("_raised").isNotNull()).select(*KEPT)


def transcribe_pages(pages: DataFrame, make_model: Callable, path: str, attempts: int = 3, per_task: int = 50) -> DataFrame:
    """One row per page: sheet_id, page_index, page_w, page_h, reply (the last one), error (null if it can be used), attempts.

    `pages`: sheet_id, page_index, page_w, page_h, content (the image's bytes). `path` holds the work table; what it holds of
    an earlier run over the same pages is taken as it is. A task asks for about `per_task` pages, or for more where that would
    make more than TASKS_A_CORE tasks a core; it holds about `per_task` of them at once. A page that still has an
    error is a reject; `grade_sheets` fails its sheet.
    """
    spark = pages.sparkSession
    asked = pages.select(*PAGE, "page_w", "page_h", "content")
    done = None
    for k in range(1, attempts + 1):
        raw, folder = f"{path}/raw/attempt={k}", f"{path}/judged/attempt={k}"
        if k == 1:
            todo = asked.withColumn("prompt", F.lit(PAGE_PROMPT))
        else:
            again = done.where("error IS NOT NULL AND NOT final").select(*PAGE, "error")
            todo = asked.join(again, list(PAGE)).withColumn("prompt", retry_prompt(k, attempts, F.col("error"))).drop("error")
        if not table_exists(spark, f"{folder}/_SUCCESS"):
            if not table_exists(spark, f"{raw}/_SUCCESS"):
                n = (asked if k == 1 else again).count()
                if n == 0:
                    break
                tasks = min(math.ceil(n / per_task), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
                called = call_image(todo.repartition(tasks, *PAGE), "content", "prompt", make_model).drop("content", "prompt", "attempts")
                with _images_at_once(spark, per_task):
                    called.write.mode("overwrite").parquet(raw)
            judged(spark.read.parquet(raw)).write.mode("overwrite").parquet(folder)
        done = spark.read.parquet(folder)
    if done is None:
        return asked.select(*PAGE, "page_w", "page_h", F.lit("").alias("reply"), F.lit("").alias("error"), F.lit(0).cast("long").alias("attempts")).limit(0)
    every = spark.read.parquet(f"{path}/judged")
    last = every.groupBy(*PAGE).agg(F.max_by(F.struct("page_w", "page_h", "reply", "error"), "attempt").alias("l"), F.max("attempt").cast("long").alias("attempts"))
    return last.select(*PAGE, "l.page_w", "l.page_h", "l.reply", "l.error", "attempts")

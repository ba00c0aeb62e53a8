"""Running streams: sinks, checkpoints, grading on arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.functions.text import answer_hash
from rubrica.functions.vectors import hash_embed
from rubrica.operators.rubric import questions_to_reindex
from rubrica.plans.grade import grade_sheets, write_graded
from rubrica.plans.index import index_questions
from rubrica.session import cut_lineage, shared_dir
from rubrica.sources.sinks import PER_BUCKET, bucket_of, replace_rows, table_exists, write_concepts
from rubrica.streaming.states import stage_moves

#: A micro-batch reads about so much of its input files, unless the caller says otherwise.
BATCH_BYTES = 256 << 20


def run_available(stream: DataFrame, mode: str = "append", out: str | None = None, mark: str | None = None) -> DataFrame:
    """Run a stream over all input there is, into a parquet table (of the shared folder if none is named), and return it."""
    spark = stream.sparkSession
    out, mark = out or shared_dir(spark, "stream-out"), mark or shared_dir(spark, "stream-mark")
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", mark)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def for_each(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that hands each micro-batch and its number to `handle`; ends when the input there is has been read."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def grade_stream(
    source: DataFrame, sheets: DataFrame, questions: DataFrame, concepts: DataFrame, path: str, checkpoint: str, embed=None,
    per_bucket: int = PER_BUCKET, writer: str = "grade_stream",
) -> None:
    """Grade page replies as they arrive, all pages of a sheet in one file. A sheet that is sent again replaces its rows in all
    tables at once.

    A batch is committed under `writer` and its number, so one that Spark repeats after a failure changes nothing. A stream
    that starts over with a new checkpoint numbers its batches anew and needs a writer's name of its own.
    """

    def grade(batch: DataFrame, number: int) -> None:
        batch.persist()
        here = sheets.join(batch.select("sheet_id").distinct(), "sheet_id", "left_semi")
        write_graded(grade_sheets(batch, here, questions, concepts, embed=embed), path, per_bucket, (writer, number))
        batch.unpersist()

    for_each(source, grade, checkpoint)


def follow_stages(events: DataFrame, path: str, checkpoint: str, by: str = "stage") -> None:
    """Keep counts per stage up to date: after each micro-batch, `path`/batch=<n> holds stage and sheets as they are then.

    A batch's counts are those of the batch before plus the sum of its moves, as many rows as there are stages. A batch that
    is repeated writes the same rows over its own folder.
    """
    spark = events.sparkSession

    def add(moves: DataFrame, batch: int) -> None:
        total = moves.select("stage", "delta")
        before = f"{path}/batch={batch - 1:010d}"
        if batch and table_exists(spark, before):
            total = total.unionByName(spark.read.parquet(before).select("stage", F.col("sheets").alias("delta")))
        counts = total.groupBy("stage").agg(F.sum("delta").alias("sheets")).where("sheets <> 0")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch:010d}")

    query = (
        stage_moves(events, by)
        .writeStream.foreachBatch(add)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def newest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of the last batch that `follow_stages` wrote."""
    counts = spark.read.parquet(path)
    last = counts.agg(F.max("batch")).first()[0]
    return counts.where(F.col("batch") == last).select("stage", "sheets")


def reindex_on_change(
    versions: DataFrame, path: str, checkpoint: str, embed: Callable = hash_embed, per_bucket: int = PER_BUCKET, **models
) -> None:
    """Index the concepts of questions as their model answers change, into `path`/concepts.

    `versions`: question_id, seq, question, model_answer. Of a micro-batch the newest version of each question counts, and
    only if its seq is above the one in `path`/indexed (question_id, seq, model_answer_hash, reason), so that a version that
    arrives late never replaces a newer one. If its answer's hash differs, its concepts are made and replace the old ones;
    a reply without concepts leaves the question without any, and the reason. The mark in `indexed` is written after the
    concepts: a batch that was cut off between the two is done again with the same outcome, and a repeated one changes nothing.
    """
    spark = versions.sparkSession
    marks, concepts_path = f"{path}/indexed", f"{path}/concepts"

    def index(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("question_id").agg(
            F.max("seq").alias("seq"), F.max_by(F.struct("question", "model_answer"), "seq").alias("v")
        )
        newest = newest.select("question_id", "seq", "v.question", "v.model_answer")
        if table_exists(spark, marks):
            known = spark.read.parquet(marks).select("question_id", F.col("seq").alias("_seq"), "model_answer_hash")
        else:
            known = newest.limit(0).select("question_id", F.col("seq").alias("_seq"), F.lit("").alias("model_answer_hash"))
        fresh = newest.join(known.select("question_id", "_seq"), "question_id", "left").where("_seq IS NULL OR seq > _seq")
        fresh = cut_lineage(fresh.drop("_seq"))
        changed = cut_lineage(questions_to_reindex(fresh, known))
        made, rejected = index_questions(changed.drop("model_answer_hash"), known, embed=embed, **models)
        write_concepts(made, concepts_path, changed.select("question_id"), per_bucket)
        reasons = rejected.select("question_id", F.col("reason").alias("reason"))
        rows = fresh.select("question_id", "seq", answer_hash("model_answer").alias("model_answer_hash")).join(reasons, "question_id", "left")
        rows = rows.select("question_id", "seq", "model_answer_hash", F.col("reason").cast("string").alias("reason"))
        replace_rows(rows.withColumn("question_bucket", bucket_of("question_id", per_bucket)), marks, "question_id", ["question_bucket"])

    for_each(versions, index, checkpoint)


def read_table_stream(
    spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int | None = None, bytes_per_trigger: int = BATCH_BYTES
) -> DataFrame:
    """Stream over the parquet files of a folder whose name matches `pattern`, some files or bytes of them a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(folder)

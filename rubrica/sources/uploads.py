"""Page files: scan, upload admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rubrica.config import MAX_FILE_BYTES, MAX_PAGES, MAX_UPLOAD_BYTES, SIGNATURES


def page_type(path: Column) -> Column:
    """Declared type of a page by its extension, null for any other file."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(ext.isin("jpg", "jpeg"), "image/jpeg")
        .when(ext == "png", "image/png")
        .when(ext == "pdf", "application/pdf")
    )


def read_pages(spark: SparkSession, glob: str, with_content: bool = False) -> DataFrame:
    """Pages of sheets stored as <sheet_id>/<index>.<ext>: sheet_id, page_index, type, length[, content].

    Content is only read when it is asked for; the listing alone touches no file body.
    """
    cols = ["path", "length"] + (["content"] if with_content else [])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob).select(*cols)
    sheet = F.regexp_extract("path", r"/(\d+)/(\d+)\.[A-Za-z0-9]+$", 1).try_cast("bigint")
    index = F.regexp_extract("path", r"/(\d+)/(\d+)\.[A-Za-z0-9]+$", 2).try_cast("bigint")
    return files.select(
        sheet.alias("sheet_id"), index.alias("page_index"), page_type(F.col("path")).alias("content_type"), *cols
    )


def signature_type(content: Column) -> Column:
    """Type by leading bytes, null when none matches."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for kind, sig in SIGNATURES.items():
        out = F.when(head.startswith(sig), kind).otherwise(out)
    return out


def reject_pages(pages: DataFrame) -> DataFrame:
    """Pages a grader cannot read: wrong bytes, or a PDF over the page limit (`pdf_pages` supplied as metadata)."""
    bad = F.col("actual_type").isNull() | (F.col("actual_type") != F.col("content_type"))
    long_pdf = (F.col("content_type") == "application/pdf") & (F.col("pdf_pages") > MAX_PAGES)
    reason = F.when(bad, "Could not decode uploaded page").when(
        long_pdf,
        F.concat(F.lit("PDF has "), F.col("pdf_pages").cast("string"), F.lit(f" pages — the limit is {MAX_PAGES}.")),
    )
    return pages.withColumn("reason", reason).where("reason IS NOT NULL")


def file_reason(name: Column, declared: Column, size: Column, actual: Column) -> Column:
    return (
        F.when(~F.coalesce(declared.isin(*SIGNATURES), F.lit(False)), F.concat(name, F.lit(": only JPG, PNG and PDF are accepted.")))
        .when(size > MAX_FILE_BYTES, F.concat(name, F.lit(": larger than 10 MB.")))
        .when(
            actual.isNull() | (actual != declared),
            F.concat(name, F.lit(": file content doesn't match a JPG, PNG or PDF.")),
        )
    )


def admit_uploads(files: DataFrame) -> DataFrame:
    """One row per upload: page_count, total_bytes and `reason`, null when admitted.

    `files`: upload_id, file_no, name, declared, size, content. Checked in order: number of pages, the first bad file,
    total size. A map-side aggregate, so an upload of any number of files is one row.
    """
    judged = files.withColumn(
        "_r", file_reason(F.col("name"), F.col("declared"), F.col("size"), signature_type(F.col("content")))
    )
    per = judged.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum("size").alias("total_bytes"),
        F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("file_no"))).alias("_first"),
    )
    total_mb = F.floor(F.col("total_bytes") / (1024 * 1024)).cast("string")
    return per.withColumn(
        "reason",
        F.when(F.col("page_count") > MAX_PAGES, F.lit(f"Ensure this field has no more than {MAX_PAGES} elements."))
        .when(F.col("_first").isNotNull(), F.col("_first"))
        .when(
            F.col("total_bytes") > MAX_UPLOAD_BYTES,
            F.concat(F.lit("Upload is "), total_mb, F.lit(" MB total — the limit is 40 MB.")),
        ),
    ).drop("_first")


def admitted_files(files: DataFrame) -> DataFrame:
    ok = admit_uploads(files).where("reason IS NULL").select("upload_id")
    return files.join(ok, "upload_id", "left_semi")

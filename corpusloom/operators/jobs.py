"""Upload checks and per-job roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import suffix
from ..functions.routes import FORMATS, HTML, MHTML, PDF, SHEETS, SLIDES, WORD, TEXT_EXTENSIONS, conversion_route
from ..functions.text import preview, size_kb
from .assembly import assemble, part_number
from .selection import glob_choice

MAX_UPLOAD_BYTES = 50 * 1024 * 1024

# Upload rules and the formats a job accepts.
ALLOWED_UPLOADS = [".txt", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".html", ".htm"]
SUSPICIOUS_UPLOADS = [".exe", ".bat", ".cmd", ".sh", ".js", ".php", ".py"]
ALLOWED_CONTENT_TYPES = [
    "text/plain",
    "application/pdf",
    "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.ms-powerpoint",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "text/html",
]
CONVERTIBLE = [".txt", ".pdf", ".docx", ".xlsx", ".pptx", ".html", ".htm"]
JOB_FORMATS = ["text", "pdf", "html", "docx", "xlsx", "pptx"]
JOB_COMMANDS = ["convert", "export"]


def reject_reason(filename: Column, content_type: Column, length: Column) -> Column:
    """Why an upload is refused, by the first failing rule, or NULL."""
    extension = suffix(filename)
    return (
        F.when(length > MAX_UPLOAD_BYTES, F.concat(F.lit("File "), filename, F.lit(" exceeds maximum size of 50MB")))
        .when(extension.isin(SUSPICIOUS_UPLOADS), F.concat(F.lit("File type not allowed: "), extension))
        .when(~extension.isin(ALLOWED_UPLOADS), F.concat(F.lit("Unsupported file type: "), extension))
        .when(
            content_type.isNull() | ~content_type.isin(ALLOWED_CONTENT_TYPES), F.lit("Invalid file type detected")
        )
    )


def validate_uploads(uploads: DataFrame) -> DataFrame:
    """Add ``reject_reason``; uploads without a file name are skipped."""
    named = uploads.where(F.col("filename") != "")
    return named.withColumn(
        "reject_reason", reject_reason(F.col("filename"), F.col("content_type"), F.col("length"))
    )


def request_verdicts(validated: DataFrame) -> DataFrame:
    """``(job_id, n_files, n_rejected, error)``: the first refused upload rejects its job."""
    refused = F.col("reject_reason").isNotNull()
    return validated.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(refused).alias("n_rejected"),
        F.min_by("reject_reason", F.when(refused, F.col("pos"))).alias("error"),
    )


def convertible(
    uploads: DataFrame,
    max_size_kb: int | None = None,
    pattern_mode: str = "exclude",
    pattern_input: str | None = None,
) -> DataFrame:
    """Uploads a job converts: known type, within the size limit if there is one, let through by the glob list."""
    name = F.col("filename")
    chosen = uploads.where(suffix(name).isin(CONVERTIBLE) & glob_choice(name, pattern_mode, pattern_input))
    return chosen if max_size_kb is None else chosen.where(size_kb(F.col("length")) <= max_size_kb)


def job_counts(results: DataFrame) -> DataFrame:
    """``(job_id, n_files, n_errors, last_ok)``, reduced in each task before the shuffle."""
    ok = F.col("error").isNull()
    return results.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(~ok).alias("n_errors"),
        F.coalesce(F.max(F.when(ok, F.col("pos"))), F.lit(0)).cast("bigint").alias("last_ok"),
    )


def outer_failure(command: Column, output_format: Column, n_files: Column) -> Column:
    """Why a job as a whole cannot run, or NULL."""
    return (
        F.when(~command.isin(JOB_COMMANDS), F.concat(F.lit("Invalid command: "), command))
        .when(
            (command == "convert") & ~output_format.isin(JOB_FORMATS),
            F.concat(
                F.lit("Invalid format: "), output_format, F.lit(". Valid formats are: " + ", ".join(JOB_FORMATS))
            ),
        )
        .when(F.coalesce(n_files, F.lit(0)) == 0, F.lit("No files match the filtering criteria"))
    )


def _progress(n_files: Column, n_errors: Column, last_ok: Column) -> Column:
    reached = F.lit(100.0) * last_ok / F.when(n_files > 0, n_files)
    return F.when(n_errors == 0, F.lit(100.0)).otherwise(reached)


def job_status(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """``(job_id, status, progress, n_files, n_errors, failure)`` for every job.

    ``jobs`` has ``job_id``, ``command`` and ``format``; ``results`` one row per file
    with its 1-based ``pos``. A job that cannot run is ``failed``; otherwise it is
    ``completed`` or ``completed_with_errors``, whose progress stands at the last
    successful file.
    """
    joined = jobs.join(job_counts(results), "job_id", "left")
    n_files = F.coalesce("n_files", F.lit(0)).cast("bigint")
    n_errors = F.coalesce("n_errors", F.lit(0)).cast("bigint")
    failure = outer_failure(F.col("command"), F.col("format"), F.col("n_files"))
    return joined.select(
        "job_id",
        F.when(failure.isNotNull(), "failed")
        .when(n_errors == 0, "completed")
        .otherwise("completed_with_errors")
        .alias("status"),
        F.when(failure.isNotNull(), F.lit(0.0))
        .otherwise(_progress(n_files, n_errors, F.col("last_ok")))
        .alias("progress"),
        n_files.alias("n_files"),
        n_errors.alias("n_errors"),
        F.when(failure.isNotNull(), F.concat(F.lit("Job failed: "), failure)).alias("failure"),
    )


def job_errors(results: DataFrame) -> DataFrame:
    """``(job_id, pos, message)``: one ordered row per failed file."""
    failed = results.where(F.col("error").isNotNull())
    return failed.select(
        "job_id",
        "pos",
        F.concat(F.lit("Error converting "), F.col("filename"), F.lit(": "), F.col("error")).alias("message"),
    )


def error_details(results: DataFrame) -> DataFrame:
    """``(job_id, part_no, cut_no, message)``: a job's messages joined by newlines, in parts by position."""
    return assemble(job_errors(results), ["job_id"], ["pos"], part_number(F.col("pos")), "message")


def first_previews(outputs: DataFrame, chars: int = 1000) -> DataFrame:
    """``(job_id, file, preview)`` of each job's first ``.text`` output.

    ``outputs`` has ``job_id``, ``pos``, ``output`` and ``text``; texts are cut to the
    preview before they are sorted and shuffled.
    """
    texts = outputs.where(F.col("output").endswith(".text")).select(
        "job_id", "pos", F.col("output").alias("file"), preview(F.col("text"), chars).alias("preview")
    )
    first = F.min_by(F.struct("file", "preview"), "pos")
    return texts.groupBy("job_id").agg(first.alias("first")).select("job_id", "first.file", "first.preview")


def route_dim(spark: SparkSession) -> DataFrame:
    """``(ext, format_key, known_outcome)`` for every listed extension and format, with
    ``other`` for formats not listed: a fixed small table."""
    extensions = [*WORD, *SHEETS, *SLIDES, *MHTML, *HTML, *PDF, *(t for t in TEXT_EXTENSIONS if t not in HTML)]
    pairs = spark.createDataFrame(
        [(e, f) for e in extensions for f in [*FORMATS, "other"]], "ext string, format_key string"
    )
    return pairs.withColumn("known_outcome", conversion_route(F.col("ext"), F.col("format_key")))


def lookup_routes(requests: DataFrame) -> DataFrame:
    """Add ``outcome`` by joining the route table on ``(ext, format)``.

    Extensions it does not list follow the rule for other inputs.
    """
    keyed = requests.withColumn("format_key", F.when(F.col("format").isin(FORMATS), F.col("format")).otherwise("other"))
    joined = keyed.join(F.broadcast(route_dim(requests.sparkSession)), ["ext", "format_key"], "left")
    other_input = conversion_route(F.lit(""), F.col("format"))
    return joined.withColumn("outcome", F.coalesce("known_outcome", other_input)).drop("format_key", "known_outcome")

"""Convert a table of documents to one output format.

Binary formats come in decoded, as element tables; text and HTML come as bytes. Every
file ends in exactly one outcome: its text, in numbered parts, or the reason it was not
converted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routes
from ..functions.html import html_text
from ..functions.paths import suffix
from ..functions.ranges import constant_ranges, page_error
from ..functions.text import is_blank
from ..operators import assembly, jobs
from ..operators.numbering import number_rows
from ..session import stage
from ..sources.decode import lenient_text


@dataclass(frozen=True)
class Elements:
    """Decoded documents: Word elements, sheet cells, slide shapes, page texts."""

    words: DataFrame | None = None
    cells: DataFrame | None = None
    shapes: DataFrame | None = None
    page_texts: DataFrame | None = None


def _result(
    frame: DataFrame, output: Column, text: Column, error: Column, part: Column | None = None, cut: Column | None = None
) -> DataFrame:
    part_no, cut_no = (F.lit(0) if number is None else number for number in (part, cut))
    return frame.select(
        "path",
        output.alias("output"),
        F.when(text.isNotNull(), part_no).cast("bigint").alias("part_no"),
        F.when(text.isNotNull(), cut_no).cast("bigint").alias("cut_no"),
        text.alias("text"),
        error.alias("error"),
    )


def _only_pages(rows: DataFrame, number: str, pages: str | None) -> DataFrame:
    """Rows of the requested pages: a plain filter, as the selection is a constant."""
    if not pages:
        return rows
    wanted = (F.col(number).between(low, high) for low, high in constant_ranges(pages))
    return rows.where(reduce(Column.__or__, wanted))


@dataclass(frozen=True)
class _Kind:
    """The assembled parts of one kind of document, and the number that a page selection goes by."""

    texts: DataFrame
    numbered: DataFrame | None = None


def _kinds(parts: Elements, documents: DataFrame, formats: tuple[str, ...], pages: str | None) -> Iterator[_Kind]:
    """The documents that come as elements; elements of any other document are left out."""

    def own(table: DataFrame, fmt: str) -> DataFrame:
        return table.join(documents.where(F.col("format") == fmt).select("path"), "path", "left_semi")

    if "csv" in formats and parts.cells is not None:
        lines = assembly.sheet_csv_lines(own(parts.cells, "csv"), ["path"]).drop("sheet_no")
        yield _Kind(assembly.sheet_csv_text(lines, ["path"]))
    if "text" not in formats:
        return
    if parts.words is not None:
        lines = assembly.word_lines(own(parts.words, "text"), ["path"])
        yield _Kind(assembly.word_text(lines, ["path"]))
    if parts.cells is not None:
        lines = assembly.sheet_lines(own(parts.cells, "text"), ["path"])
        yield _Kind(assembly.sheet_text(lines, ["path"]))
    if parts.shapes is not None:
        shapes = own(parts.shapes, "text")
        lines = assembly.slide_lines(_only_pages(shapes, "slide_no", pages), ["path"])
        yield _Kind(assembly.slide_text(lines, ["path"]), shapes.select("path", F.col("slide_no").alias("n")))
    if parts.page_texts is not None:
        texts = own(parts.page_texts, "text")
        lines = assembly.page_lines(_only_pages(texts, "page_no", pages), ["path"], headed=bool(pages))
        yield _Kind(assembly.page_text(lines, ["path"]), texts.select("path", F.col("page_no").alias("n")))


def _without_content(documents: DataFrame, found: DataFrame | None, kinds: list[_Kind], pages: str | None) -> DataFrame:
    """Documents that gave no part (``found`` has the others' paths), and why."""
    nothing = F.lit("No content found in the document")
    if found is None:
        return _result(documents, F.col("output"), F.lit(None).cast("string"), nothing)
    empty = documents.join(found.distinct(), "path", "left_anti")
    numbered = [k.numbered for k in kinds if k.numbered is not None]
    if pages and numbered:
        lengths = reduce(DataFrame.unionByName, numbered).groupBy("path").agg(F.max("n").alias("n_pages"))
        empty = empty.join(lengths, "path", "left")
        nothing = F.coalesce(page_error(F.lit(pages), F.col("n_pages")), nothing)
    return _result(empty, F.col("output"), F.lit(None).cast("string"), nothing)


def convert(
    files: DataFrame, output_format: str | None, parts: Elements = Elements(), pages: str | None = None
) -> DataFrame:
    """``(path, output, part_no, cut_no, text, error)``: what became of every file.

    ``files`` has ``path`` and ``content`` (unused, and may be NULL, for documents that
    come as element tables) and, where ``output_format`` is None, the ``format`` of each.
    Elements of other documents are left out. The parts and cuts of an output in order, joined by
    newlines, are its text. A CSV conversion gives one output per sheet. A malformed
    ``pages`` is an error; a document that has none of the pages says so.
    """
    if pages:
        constant_ranges(pages)
    extension = suffix(F.col("path"))
    fmt = F.col("format") if output_format is None else F.lit(output_format)
    routed = files.select(
        "path",
        "content",
        fmt.alias("format"),
        extension.alias("ext"),
        routes.conversion_route(extension, fmt).alias("route"),
        routes.output_name(F.col("path"), fmt).alias("output"),
    )
    route, text, none = F.col("route"), lenient_text(F.col("content")), F.lit(None).cast("string")
    is_copy, is_page = route == "copy", (route == "ok") & F.col("ext").isin(routes.HTML)
    is_read = is_copy | is_page | (route == "refused")
    direct = routed.where(is_page | (route != "ok")).withColumn("read", F.when(is_read, text))
    read = F.col("read")
    blank = is_blank(read)
    results = [
        _result(
            direct,
            F.col("output"),
            F.when(is_copy & (read != ""), read).when(is_page & ~blank, html_text(read)),
            F.when(is_copy, F.when(F.coalesce(read, F.lit("")) == "", "Output file is empty"))
            .when(is_page, F.when(blank, "HTML file is empty"))
            .when(route == "refused", routes.mhtml_refusal(read))
            .when(route == "render", "HTML rendering is not available")
            .otherwise(routes.refusal(F.col("ext"), F.col("format"))),
        )
    ]
    documents = stage(routed.where(~is_page & (route == "ok")).select("path", "output", "format"))  # names alone
    formats = ("text", "csv") if output_format is None else (output_format,)
    kinds = list(_kinds(parts, documents, formats, pages))
    made = []
    for kind in kinds:
        path, by_sheet = F.col("path"), "sheet" in kind.texts.columns
        named = routes.sheet_output_name(path, F.col("sheet")) if by_sheet else routes.output_name(path, F.lit("text"))
        made.append(_result(kind.texts, named, F.col("text"), none, F.col("part_no"), F.col("cut_no")))
    # what the elements gave is staged, so that they are read and assembled once and the empty documents are known from it
    assembled = stage(reduce(DataFrame.unionByName, made)) if made else None
    results += [] if assembled is None else [assembled]
    results.append(_without_content(documents, None if assembled is None else assembled.select("path"), kinds, pages))
    return reduce(DataFrame.unionByName, results)


def file_results(uploads: DataFrame, converted: DataFrame) -> DataFrame:
    """One row per upload: its error, if any, and the name of its first output.

    ``uploads`` has ``job_id``, ``pos``, ``filename``, ``length`` and ``path``. An empty
    upload is an error, and so is an output without text.
    """
    outcome = converted.groupBy("path").agg(
        F.min("error").alias("error"),
        F.min("output").alias("output"),
        F.bool_or(F.col("text") != "").alias("filled"),
    )
    joined = uploads.join(outcome, "path", "left")
    empty = F.when(F.col("length") == 0, F.concat(F.lit("File is empty: "), "filename"))
    error = F.coalesce(empty, "error", F.when(~F.coalesce("filled", F.lit(False)), F.lit("Output file is empty")))
    output = F.when(error.isNull(), F.col("output"))
    return joined.select("job_id", "pos", "filename", error.alias("error"), output.alias("output"))


def run_jobs(
    requests: DataFrame,
    uploads: DataFrame,
    parts: Elements = Elements(),
    pages: str | None = None,
    max_size_kb: int | None = None,
    pattern_mode: str = "exclude",
    pattern_input: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Convert whole upload batches: ``(converted, file results, job status)``.

    ``uploads`` has ``job_id``, ``pos``, ``filename``, ``length``, ``path`` (unique), ``content``
    and, if uploads are to be checked, ``content_type``; ``requests`` has ``job_id``, ``command`` and
    ``format``. Every job is converted to its own format; an export is a conversion to text. A job
    with a refused upload is never started and has no status; one whose request is invalid
    is not converted and has failed. Files that pass the filters are numbered anew, which the
    progress is measured by.
    """
    if "content_type" in uploads.columns:
        verdicts = jobs.request_verdicts(jobs.validate_uploads(uploads))
        requests = requests.join(verdicts.where("error is not null"), "job_id", "left_anti")
    valid = jobs.outer_failure(F.col("command"), F.col("format"), F.lit(1)).isNull()
    wanted = F.when(F.col("command") == "export", "text").otherwise(F.col("format"))
    started = requests.where(valid).select("job_id", wanted.alias("format"))
    chosen = jobs.convertible(uploads, max_size_kb, pattern_mode, pattern_input).join(started, "job_id")
    converted = convert(chosen.select("path", "content", "format"), None, parts, pages)
    asked = chosen.select("job_id", F.col("pos").alias("_asked"), "filename", "length", "path")
    listed = number_rows(asked, ["job_id"], "_asked")
    results = file_results(listed, converted)
    return converted, results, jobs.job_status(requests, results)

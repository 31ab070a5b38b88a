"""Which conversions are possible, and what their output is called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import base_name, name, stem, suffix

# The extension groups of the conversion matrix.
WORD = [".doc", ".docx"]
SHEETS = [".xls", ".xlsx"]
SLIDES = [".ppt", ".pptx"]
MHTML = [".mhtml", ".mht"]
HTML = [".html", ".htm"]
PDF = [".pdf"]

# Extensions always read as text, and always taken as binary.
TEXT_EXTENSIONS = [
    ".txt", ".py", ".md", ".json", ".yml", ".yaml", ".ini", ".cfg", ".sh", ".bash", ".js", ".css", ".html",
    ".xml", ".rst", ".bat", ".java", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".go", ".rs",
]
BINARY_EXTENSIONS = [
    ".bin", ".jpg", ".jpeg", ".pdf", ".exe", ".dll", ".so", ".dylib", ".zip", ".tar", ".gz",
]

FORMATS = ["text", "csv", "pdf", "image"]


def conversion_route(extension: Column, output_format: Column) -> Column:
    """Outcome per (extension, format): ``ok``, ``copy`` or a kind of refusal.

    ``render`` marks a conversion that exists but needs a page renderer.
    """
    is_image = output_format == "image"
    gone = F.lit("no longer supported")
    unsupported = F.lit("unsupported")
    no_other = F.when(is_image, gone).otherwise(unsupported)
    return (
        F.when(extension.isin(WORD + SLIDES), F.when(output_format == "text", "ok").otherwise(no_other))
        .when(
            extension.isin(SHEETS),
            F.when(output_format.isin("text", "csv"), "ok").otherwise(no_other),
        )
        .when(extension.isin(MHTML), F.lit("refused"))
        .when(
            extension.isin(HTML),
            F.when(output_format == "text", "ok").when(output_format == "pdf", "render").otherwise(no_other),
        )
        .when(extension.isin(TEXT_EXTENSIONS), F.lit("copy"))
        .when(
            extension.isin(PDF),
            F.when(output_format == "text", "ok").when(output_format == "csv", "error").otherwise(no_other),
        )
        .when(output_format == "text", F.lit("copy"))
        .when(is_image, gone)
        .when(output_format == "csv", F.lit("error"))
        .otherwise(F.lit("unsupported input"))
    )


def refusal(extension: Column, output_format: Column) -> Column:
    """Why a conversion is not done, or NULL where it is (``ok``, ``copy``, ``render``)."""
    outcome = conversion_route(extension, output_format)
    kind = (
        F.when(extension.isin(WORD), "Word")
        .when(extension.isin(SHEETS), "Excel")
        .when(extension.isin(SLIDES), "PowerPoint")
        .when(extension.isin(HTML), "HTML")
        .when(extension.isin(PDF), "PDF")
    )
    general_image = extension.isin(PDF) | kind.isNull()
    gone = F.when(general_image, "Image").otherwise(F.concat(kind, F.lit(" to image")))
    unsupported = F.when(
        kind == "Word", F.concat(F.lit("Unsupported output format "), output_format, F.lit(" for Word documents"))
    ).otherwise(F.concat(F.lit("Unsupported output format for "), kind, F.lit(" documents: "), output_format))
    return (
        F.when(outcome == "no longer supported", F.concat(gone, F.lit(" conversion is no longer supported")))
        .when(outcome == "unsupported", unsupported)
        .when(outcome == "unsupported input", F.concat(F.lit("Unsupported input format: "), extension))
        .when(outcome == "error", F.lit("No sheet to convert to CSV"))
        .when(outcome == "refused", F.lit("MHTML conversion is refused"))
    )


def output_name(path: Column, output_format: Column) -> Column:
    """Name of the converted file."""
    extension = suffix(path)
    return (
        F.when((output_format == "text") & extension.isin(HTML + MHTML), F.concat(base_name(path), F.lit(".text")))
        .when((output_format == "text") & extension.isin(PDF), F.concat(stem(path), F.lit(".pdf.text")))
        .otherwise(F.concat(base_name(path), F.lit("."), output_format))
    )


def sheet_output_name(path: Column, sheet: Column) -> Column:
    """Name of the CSV file of one sheet."""
    return F.concat(stem(path), F.lit("_"), F.replace(sheet, F.lit(" "), F.lit("_")), F.lit(".csv"))


def upload_output_name(path: Column, output_format: Column) -> Column:
    """Name of a converted upload: the format is appended to the full name."""
    return F.concat(name(path), F.lit("."), output_format)


def mhtml_refusal(text: Column) -> Column:
    """Why an MHTML file is refused: its markers are missing, or the format is retired."""
    marked = F.contains(text, F.lit("MIME-Version: 1.0")) & F.contains(
        text, F.lit("Content-Type: multipart/related")
    )
    return F.when(F.coalesce(marked, F.lit(False)), F.lit("MHTML conversion is no longer supported")).otherwise(
        F.lit("Invalid MIME structure")
    )

import pytest
from corpusloom.functions import routes
from corpusloom.plans.convert import Elements, convert, run_jobs
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def parts(spark):
    words = [("w.docx", "paragraph", None, None, None, 0, " Head "), ("w.docx", "cell", 1, 0, 0, None, "a"), ("w.docx", "cell", 1, 0, 1, None, "b")]
    cells = [("b.xlsx", "My Sheet", 1, 1, 1, "x,y", "str"), ("b.xlsx", "Two", 2, 1, 1, "1.5", "float")]
    shapes = [("s.pptx", n, 0, f"title {n}") for n in (1, 2, 3)]
    pages = [("p.pdf", n, f" page {n} ") for n in (1, 2, 3)] + [("other.pdf", 1, "not asked for")]
    return Elements(
        spark.createDataFrame(words, "path string, kind string, table_no bigint, row_no bigint, col_no int, seq bigint, text string"),
        spark.createDataFrame(cells, "path string, sheet string, sheet_no int, row_no bigint, col_no int, value string, vtype string"),
        spark.createDataFrame(shapes, "path string, slide_no bigint, shape_no bigint, text string"),
        spark.createDataFrame(pages, "path string, page_no bigint, text string"),
    )


FILES = [
    ("w.docx", None), ("b.xlsx", None), ("s.pptx", None), ("p.pdf", None), ("none.docx", None), ("a.txt", b"caf\xe9"),
    ("a.html", b"<p>x</p><p>y</p>"), ("blank.html", b" "), ("empty.txt", b""), ("m.mht", b"MIME-Version: 1.0"), ("z.zip", b"zip"),
]


def outcomes(frame):
    """Outcome by path and output; the parts of a text joined in order."""
    found = {}
    for r in sorted(frame.collect(), key=lambda r: r.part_no or 0):
        text, _ = found.get((r.path, r.output), (None, None))
        found[r.path, r.output] = (r.text if text is None else f"{text}\n{r.text}", r.error)
    return found


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, content binary")


def test_text_of_everything(files, parts):
    assert outcomes(convert(files, "text", parts)) == {
        ("w.docx", "w.text"): ("Head\na | b", None),
        ("b.xlsx", "b.text"): ("Sheet: My Sheet\n\nx,y\nSheet: Two\n\n1.5", None),
        ("s.pptx", "s.text"): ("Slide 1:\ntitle 1\n\nSlide 2:\ntitle 2\n\nSlide 3:\ntitle 3\n", None),
        ("p.pdf", "p.pdf.text"): ("page 1\npage 2\npage 3", None),
        ("none.docx", "none.text"): (None, "No content found in the document"),
        ("a.txt", "a.text"): ("café", None),
        ("a.html", "a.text"): ("x\ny", None),
        ("blank.html", "blank.text"): (None, "HTML file is empty"),
        ("empty.txt", "empty.text"): (None, "Output file is empty"),
        ("m.mht", "m.text"): (None, "Invalid MIME structure"),
        ("z.zip", "z.text"): ("zip", None),
    }


def test_selected_pages_and_slides(files, parts):
    found = outcomes(convert(files, "text", parts, pages="2-9"))
    assert found["p.pdf", "p.pdf.text"][0] == "\n=== Page 2 ===\n\npage 2\n\n=== Page 3 ===\n\npage 3"
    assert found["s.pptx", "s.text"][0].startswith("Slide 2:")
    found = outcomes(convert(files, "text", parts, pages="9-10"))
    assert found["p.pdf", "p.pdf.text"] == (None, "No valid pages in range: 9-10 (document has 3 pages)")
    assert found["none.docx", "none.text"] == (None, "No content found in the document")
    with pytest.raises(ValueError, match="x-1"):
        convert(files, "text", parts, pages="x-1")


def test_csv_gives_one_output_per_sheet(files, parts):
    found = outcomes(convert(files, "csv", parts))
    assert found["b.xlsx", "b_My_Sheet.csv"] == ('"x,y"', None) and found["b.xlsx", "b_Two.csv"] == ("1.5", None)
    assert found["w.docx", "w.csv"] == (None, "Unsupported output format csv for Word documents")
    assert found["a.txt", "a.csv"] == ("café", None) and found["p.pdf", "p.csv"][1] is not None
    assert {p for p, _ in found} == {p for p, _ in FILES}


@pytest.mark.parametrize(
    "path, fmt, message",
    [
        ("a.doc", "image", "Word to image conversion is no longer supported"),
        ("a.xls", "image", "Excel to image conversion is no longer supported"),
        ("a.xls", "pdf", "Unsupported output format for Excel documents: pdf"),
        ("a.ppt", "docx", "Unsupported output format for PowerPoint documents: docx"),
        ("a.htm", "csv", "Unsupported output format for HTML documents: csv"),
        ("a.pdf", "image", "Image conversion is no longer supported"),
        ("a.pdf", "docx", "Unsupported output format for PDF documents: docx"),
        ("a.zip", "docx", "Unsupported input format: .zip"),
        ("a.zip", "image", "Image conversion is no longer supported"),
        ("a.py", "image", None),
        ("a.docx", "text", None),
        ("a.htm", "pdf", None),
    ],
)
def test_refusals(spark, path, fmt, message):
    from corpusloom.functions.paths import suffix

    row = spark.range(1).select(routes.refusal(suffix(F.lit(path)), F.lit(fmt)).alias("m")).first()
    assert row.m == message


def test_jobs_from_upload_to_status(spark, parts):
    rows = [
        ("j1", 0, "a.txt", 3, "j1/a.txt", b"one"), ("j1", 1, "skip.py", 3, "j1/skip.py", b"py"), ("j1", 2, "blank.html", 1, "j1/blank.html", b" "),
        ("j1", 3, "c.txt", 3, "j1/c.txt", b"two"), ("j1", 4, "p.pdf", 9, "p.pdf", None),
        ("j2", 0, "x.txt", 3, "j2/x.txt", b"ok"), ("j3", 0, "big.txt", 2_000_000, "j3/big.txt", b"big"),
        ("j4", 0, "e.txt", 0, "j4/e.txt", b""), ("j4", 1, "f.txt", 1, "j4/f.txt", b"f"),
    ]
    uploads = spark.createDataFrame(rows, "job_id string, pos bigint, filename string, length bigint, path string, content binary")
    requests = spark.createDataFrame([(j, "convert", "text") for j in ("j1", "j2", "j3", "j4", "j5")], "job_id string, command string, format string")
    converted, results, status = run_jobs(requests, uploads, parts=parts, max_size_kb=1000)
    assert "other.pdf" not in {r.path for r in converted.collect()}
    found = {(r.job_id, r.pos): (r.filename, r.error, r.output) for r in results.collect()}
    assert found == {
        ("j1", 1): ("a.txt", None, "a.text"), ("j1", 2): ("blank.html", "HTML file is empty", None), ("j1", 3): ("c.txt", None, "c.text"),
        ("j1", 4): ("p.pdf", None, "p.pdf.text"), ("j2", 1): ("x.txt", None, "x.text"),
        ("j4", 1): ("e.txt", "File is empty: e.txt", None), ("j4", 2): ("f.txt", None, "f.text"),
    }
    assert {r.job_id: (r.status, r.progress) for r in status.collect()} == {
        "j1": ("completed_with_errors", 100.0), "j2": ("completed", 100.0), "j3": ("failed", 0.0),
        "j4": ("completed_with_errors", 100.0), "j5": ("failed", 0.0),
    }


def test_jobs_have_their_own_format_and_refusals(spark, parts):
    rows = [("t", 0, "a.txt", 3, "t/a.txt", b"one", "text/plain"), ("c", 0, "b.xlsx", 3, "b.xlsx", None, "application/vnd.ms-excel"),
            ("g", 0, "a.txt", 3, "g/a.txt", b"one", "text/plain"), ("bad", 0, "a.txt", 3, "bad/a.txt", b"one", "text/plain"),
            ("bad", 1, "x.exe", 3, "bad/x.exe", b"one", "text/plain"), ("e", 0, "a.htm", 3, "e/a.htm", b"<p>x", "text/html"),
            ("p", 0, "s.pptx", 3, "s.pptx", None, "application/vnd.ms-powerpoint")]
    uploads = spark.createDataFrame(rows, "job_id string, pos bigint, filename string, length bigint, path string, content binary, content_type string")
    asked = [("t", "convert", "text"), ("c", "convert", "text"), ("g", "convert", "gif"), ("bad", "convert", "text"), ("e", "export", "none"), ("p", "convert", "pdf")]
    requests = spark.createDataFrame(asked, "job_id string, command string, format string")
    converted, results, status = run_jobs(requests, uploads, parts)
    assert {r.path for r in converted.collect()} == {"t/a.txt", "b.xlsx", "e/a.htm", "s.pptx"}
    errors = {r.job_id: r.error for r in results.collect()}
    assert errors["t"] is None and errors["c"] is None and errors["e"] is None
    assert errors["p"] == "Unsupported output format for PowerPoint documents: pdf"
    assert {r.job_id: r.status for r in status.collect()} == {"t": "completed", "c": "completed", "g": "failed", "e": "completed", "p": "completed_with_errors"}

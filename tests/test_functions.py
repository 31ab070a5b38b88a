import datetime
import math
import random
from pathlib import PurePosixPath

import pytest
from corpusloom.functions import cells, commits, paths, ranges, repo_url, routes, text
from corpusloom.sources import decode
from pyspark.sql import functions as F

NAMES = ["a.txt", "dir/a.tar.gz", ".bashrc", "x.", "..a", "a/.b.c", "noext", "d.e/f", "A.PY", "a/b/c.d.e", "x..y", "é.ü"]


def test_path_parts(evaluate):
    for name, build, rule in [
        ("name", paths.name, lambda p: p.name),
        ("suffix", paths.suffix, lambda p: p.suffix.lower()),
        ("stem", paths.stem, lambda p: p.stem),
        ("parent", paths.parent, lambda p: "" if str(p.parent) == "." else str(p.parent)),
        ("depth", paths.depth, lambda p: len(p.parts) - 1),
        ("hidden", paths.is_hidden, lambda p: any(part.startswith(".") for part in p.parts)),
        ("down", paths.folders_down_to, lambda p: [str(a) for a in list(p.parents)[::-1][1:]] + [str(p)]),
    ]:
        assert evaluate(NAMES, build) == [rule(PurePosixPath(n)) for n in NAMES], name


def test_base_name_strips_every_extension(evaluate):
    assert evaluate(["a.b.c", "a", ".bashrc", "d/x.html.text", "x."], paths.base_name) == ["a", "a", ".bashrc", "x", "x"]


def random_texts(n=400):
    rng = random.Random(7)
    alphabet = list("ab\n\t \r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　​é𝄞")
    return ["", " ", "\n"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_measures_agree_with_the_string_methods(evaluate):
    values = random_texts()
    assert evaluate(values, text.char_count) == [len(v) for v in values]
    assert evaluate(values, text.line_count) == [v.count("\n") + 1 for v in values]
    assert evaluate(values, text.token_count) == [len(v.split()) for v in values]
    assert evaluate(values, text.strip) == [v.strip() for v in values]
    assert evaluate(values, text.is_blank) == [not v.strip() for v in values]
    wanted = [v.replace("\r\n", "\n").replace("\r", "\n") for v in values]
    assert evaluate(values, text.universal_newlines) == wanted


def test_every_separator_of_the_library_separates_tokens(evaluate):
    values = [f"a{c}b" for c in map(chr, range(0x3100)) if c != "\x00"] + ["a\ufeffb", "a\U0001f600b"]
    assert evaluate(values, text.token_count) == [len(v.split()) for v in values]
    assert evaluate([f"{v[1:-1]}x" for v in values], text.strip) == [f"{v[1:-1]}x".strip() for v in values]


def test_strip_is_linear_in_inner_white_space(evaluate):
    inner = "a" + " " * 2_000_000 + "b"
    assert evaluate([f" {inner} "], lambda c: F.length(text.strip(c))) == [len(inner)]


def test_white_space_set_is_complete():
    assert set(text.WHITESPACE) == {c for c in map(chr, range(0x110000)) if c.isspace()}


def test_thousands_masks_sizes_preview(evaluate):
    assert evaluate([0, 999, 1000, 1234567], text.thousands, "bigint") == ["0", "999", "1,000", "1,234,567"]
    secrets = [None, "", "abcdef", "abcdefg", "ghp_123456789"]
    assert evaluate(secrets, text.mask_secret) == [None, "", "REDACTED", "abc...efg", "ghp...789"]
    assert evaluate([51200], text.size_kb, "bigint") == [50.0]
    assert evaluate(["é" * 1500], text.preview) == ["é" * 1000]


def test_decoding(evaluate):
    values = [b"abc", b"\xff\xfe", b"a\r\nb\rc", b"\xef\xbb\xbfx", b"", "é ".encode(), b"\xed\xa0\x80", b"\xc0\x80", b"\xf4\x90\x80\x80", b"a\x85"]

    def strict(v):
        try:
            return v.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            return None

    lenient = [s if (s := strict(v)) is not None else v.decode("latin-1").replace("\r\n", "\n").replace("\r", "\n") for v in values]
    assert evaluate(values, decode.strict_text, "binary") == [strict(v) for v in values]
    assert evaluate(values, decode.lenient_text, "binary") == lenient


def test_sources_report_empty_files(spark):
    files = spark.createDataFrame([("a", b" \n"), ("b", b"<p>"), ("c", b"")], "path string, content binary")
    assert {r.path: r.error for r in decode.html_source(files).collect()} == {
        "a": "HTML file is empty", "b": None, "c": "HTML file is empty"
    }
    assert {r.path: r.error for r in decode.copied_text(files).collect()} == {
        "a": None, "b": None, "c": "Output file is empty"
    }


def test_float_text_is_the_repr(evaluate):
    rng = random.Random(3)
    values = [0.0, -0.0, 1.0, 1e7, 150000.5, 0.15, 99.99, 1e15, 1e16, 1.5e16, 123456789012345680.0, 1e-4, 1.5e-5, -2.5e-7, 1e100, 5e-324, 9007199254740993.0, 0.1 + 0.2]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 20) for _ in range(300)]
    values += [math.inf, -math.inf, math.nan]
    found = evaluate(values, cells.float_text, "double")
    for value, shown in zip(values, found):
        assert shown == repr(value) or float(shown) == value, (value, shown)
        assert ("e" in shown) == ("e" in repr(value)), (value, shown)
    same = sum(shown == repr(value) for value, shown in zip(values, found))
    assert same >= len(values) - 5


def test_cells_by_type(spark):
    rows = [
        ("150000.5", "float", "150000.5"), ("1e7", "float", "10000000.0"), ("true", "bool", "True"),
        ("2023-01-01", "datetime", "2023-01-01 00:00:00"), ("2023-01-01 10:11:12.5", "datetime", "2023-01-01 10:11:12.500000"),
        ("42", "int", "42"), ("x", "float", "x"), ("", "str", ""), (None, "str", None),
    ]
    frame = spark.createDataFrame(rows, "value string, vtype string, wanted string")
    for row in frame.withColumn("shown", cells.cell_text(F.col("value"), F.col("vtype"))).collect():
        assert row.shown == row.wanted


def test_pipe_rows_and_csv_lines(evaluate):
    rows = [["Jane Smith", " 25 ", None, "VIP, priority service"], [None, None], ["", "x"], []]
    assert evaluate(rows, cells.pipe_row, "array<string>") == ["Jane Smith | 25 | VIP, priority service", None, " | x", None]
    assert evaluate(rows, lambda c: cells.pipe_row(c, drop_blank=True), "array<string>")[2] == "x"
    assert evaluate(rows, cells.csv_line, "array<string>") == ['Jane Smith, 25 ,,"VIP, priority service"', ",", ",x", ""]


def test_headings(evaluate):
    assert evaluate([3], cells.slide_heading, "int") == ["Slide 3:"]
    assert evaluate(["S"], cells.sheet_heading) == ["Sheet: S\n"]
    assert evaluate([2], cells.page_heading, "int") == ["\n=== Page 2 ===\n"]
    assert evaluate(["My Sheet 1"], cells.sheet_label) == ["My_Sheet_1"]


def test_commit_rendering(spark):
    at = datetime.datetime(2023, 1, 1, 0, 0, 0)
    row = spark.createDataFrame([("Initial commit", "Test Author", at)], "m string, a string, at timestamp").select(
        commits.commit_date(F.col("at")).alias("date"),
        commits.commit_line(F.col("m"), F.col("a"), commits.commit_date(F.col("at"))).alias("line"),
    ).first()
    assert row.date == "2023-01-01T00:00:00+00:00"
    assert row.line == "Last Commit: Initial commit by Test Author on 2023-01-01"


@pytest.mark.parametrize(
    "spec, wanted",
    [
        ("1-3,5", [1, 2, 3, 5]), ("1-3,7-9", [1, 2, 3, 7, 8, 9]), ("2", [2]), ("5-3", [3, 4, 5]), (" 4 ", [4]),
        ("", []), (None, []), ("x", None), ("1,,2", None), ("1-2-3", None), ("-3", None), ("3,1,3,2-3", [1, 2, 3]),
        ("1 - 3", [1, 2, 3]), ("1;2", None), (",", None), ("0", [0]),
    ],
)
def test_page_ranges(evaluate, spec, wanted):
    found = evaluate([spec], ranges.parse_page_range)[0]
    assert (None if found is None else [n for b in found for n in range(b.low, b.high + 1)]) == wanted


def test_page_bounds_never_expand_beyond_the_document(evaluate):
    specs = ["1-3,7-9", "5-3", "4-999999999999", "", None, "x", "6-8", "0-2"]
    pages = evaluate(specs, lambda c: ranges.range_text(ranges.pages_in_bounds(c, F.lit(5))))
    assert pages == ["1-3", "3-5", "4-5", "1-5", "1-5", None, "", "1-2"]
    errors = evaluate(specs, lambda c: ranges.page_error(c, F.lit(5)))
    assert errors[5] == "Invalid page number or range: x"
    assert errors[6] == "No valid pages in range: 6-8 (document has 5 pages)"
    assert [e for i, e in enumerate(errors) if i not in (5, 6)] == [None] * 6


def test_unknown_page_counts_expand_nothing(evaluate):
    specs = ["1-99999999999", "", None, "x"]
    none = F.lit(None).cast("bigint")
    assert evaluate(specs, lambda c: ranges.pages_in_bounds(c, none)) == [None] * 4
    errors = evaluate(specs, lambda c: ranges.page_error(c, none))
    assert errors == [None, None, None, "Invalid page number or range: x"]
    assert evaluate(["1-5"], lambda c: ranges.pages_in_bounds(c, F.lit(0))) == [[]]


def test_long_page_lists_do_not_overflow(evaluate):
    spec = ",".join(str(n) for n in range(1, 20001))
    assert evaluate([spec], lambda c: ranges.range_text(ranges.parse_page_range(c))) == ["1-20000"]


def test_selections_stay_ranges(evaluate):
    specs = ["1-99999999999", "3,1,2,9-7,8", "5"]
    assert evaluate(specs, lambda c: ranges.range_text(ranges.parse_page_range(c))) == ["1-99999999999", "1-3,7-9", "5"]
    assert evaluate(specs, lambda c: ranges.in_ranges(ranges.parse_page_range(c), F.lit(8))) == [True, True, False]
    assert ranges.constant_ranges("1-3, 9 - 7,4") == [(1, 3), (7, 9), (4, 4)]
    for bad in ("x-1", "", "1-2-3", "1,", "²"):
        with pytest.raises(ValueError, match="Invalid page"):
            ranges.constant_ranges(bad)


BASE = "https://github.com/owner/repo"


@pytest.mark.parametrize(
    "url, branch, subdir",
    [
        (BASE, None, None), (BASE + ".git", None, None), (BASE + "/pulls", None, None), (BASE + "/issues", None, None),
        (BASE + "/actions", None, None), (BASE + "/tree/main/path/to/dir", "main", "path/to/dir"),
        (BASE + "/tree/feature/nested/path", "feature", "nested/path"), (BASE + "/tree/main", "main", None),
    ],
)
def test_repo_urls(evaluate, url, branch, subdir):
    deep = evaluate([url], lambda c: repo_url.parse_repo_url(c, use_subdirectory=True))[0]
    assert tuple(deep) == (BASE + ".git", branch, subdir)
    assert tuple(evaluate([url], repo_url.parse_repo_url)[0]) == (BASE + ".git", branch, None)
    assert evaluate([url], repo_url.is_repo_url) == [True]


def test_invalid_repo_urls(evaluate):
    urls = [None, "", "not_a_url", "https://gitlab.com/a/b", "https://github.com/a", "ftp://github.com/a/b/tree/x"]
    assert [tuple(r) for r in evaluate(urls, repo_url.parse_repo_url)] == [(None, None, None)] * len(urls)
    assert evaluate(urls, repo_url.is_repo_url) == [False] * len(urls)


def test_repo_names(evaluate):
    assert evaluate(["https://h/o/repo.git", "https://h/o/repo/", "x"], repo_url.repo_name) == ["repo", "repo", "x"]


def test_routes_and_names(spark):
    rows = [
        ("a.docx", "text", "ok", "a.text"), ("a.docx", "csv", "unsupported", "a.csv"), ("a.doc", "image", "no longer supported", "a.image"),
        ("a.xlsx", "csv", "ok", "a.csv"), ("a.pptx", "pdf", "unsupported", "a.pdf"), ("a.mht", "text", "refused", "a.text"),
        ("b.v2.html", "text", "ok", "b.text"), ("b.htm", "pdf", "render", "b.pdf"), ("a.py", "image", "copy", "a.image"),
        ("r.v1.pdf", "text", "ok", "r.v1.pdf.text"), ("r.pdf", "csv", "error", "r.csv"), ("r.pdf", "pdf", "unsupported", "r.pdf"),
        ("z.zip", "text", "copy", "z.text"), ("z.zip", "pdf", "unsupported input", "z.pdf"), ("z.zip", "image", "no longer supported", "z.image"),
        ("z", "csv", "error", "z.csv"),
    ]
    frame = spark.createDataFrame(rows, "path string, format string, outcome string, output string")
    path, fmt = F.col("path"), F.col("format")
    for r in frame.select(
        "*",
        routes.conversion_route(paths.suffix(path), fmt).alias("o"),
        routes.output_name(path, fmt).alias("n"),
    ).collect():
        assert (r.o, r.n) == (r.outcome, r.output), r


def test_sheet_output_names(spark):
    row = spark.range(1).select(
        routes.sheet_output_name(F.lit("d/book.v1.xlsx"), F.lit("My Sheet")).alias("sheet"),
        routes.upload_output_name(F.lit("d/a.txt"), F.lit("text")).alias("upload"),
    ).first()
    assert (row.sheet, row.upload) == ("book.v1_My_Sheet.csv", "a.txt.text")


def test_mhtml(evaluate):
    both = "MIME-Version: 1.0\nContent-Type: multipart/related; x"
    assert evaluate([both, "MIME-Version: 1.0", None], routes.mhtml_refusal) == [
        "MHTML conversion is no longer supported", "Invalid MIME structure", "Invalid MIME structure"
    ]

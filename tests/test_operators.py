import datetime
import mimetypes
import random
from pathlib import PurePosixPath

import pytest
from corpusloom.operators import assembly, enrichment, ignore, jobs, listing, numbering, selection, stats, versions
from corpusloom.sources.rules import DEFAULT_PATTERNS, Rules, load_rules, parse_rules
from pyspark.sql import functions as F


def names(frame, column="path"):
    return sorted(r[column] for r in frame.collect())


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("src/a.py", 10, b"print(1)\n"),
        ("src/__init__.py", 0, b""),
        ("_priv/x.txt", 3, b"abc"),
        (".hidden", 3, b"abc"),
        (".git/config", 3, b"abc"),
        ("src/.env", 3, b"abc"),
        ("docs/edge.txt", 51200, b"e" * 100),
        ("docs/over.txt", 51201, b"o" * 100),
        ("venv/lib.py", 5, b"x = 1"),
        ("src/venv/lib.py", 5, b"x = 1"),
        ("bin/tool.exe", 5, b"MZ"),
        ("data", 5, b"ab\x00cd"),
        ("notes", 5, b"plain"),
        ("bad.txt", 2, b"\xff\xfe"),
        ("src/keep.log", 2, b"ok"),
        ("src/drop.log", 2, b"ok"),
        ("pic.png", 2, b"ok"),
        ("a.tar.gz", 2, b"ok"),
        ("a.txt.bz2", 2, b"ok"),
        ("nolength", None, b"ok"),
    ]
    return spark.createDataFrame(rows, "path string, length bigint, content binary")


def test_hidden_and_size(files):
    kept = names(selection.select_files(files, 50))
    assert set(names(selection.select_files(files))) == {*kept, "docs/over.txt", "nolength"}  # no limit unless given
    assert "docs/edge.txt" in kept and "docs/over.txt" not in kept
    assert "src/__init__.py" in kept and "_priv/x.txt" in kept
    assert not {".hidden", ".git/config", "src/.env", "nolength"} & set(kept)


def test_glob_modes(files):
    included = names(selection.select_files(files, pattern_mode="include", pattern_input="*.py; venv/*"))
    assert included == ["src/__init__.py", "src/a.py", "src/venv/lib.py", "venv/lib.py"]
    everything = names(selection.select_files(files, pattern_mode="include"))
    assert everything == names(selection.select_files(files))
    assert not {"src/a.py", "venv/lib.py"} & set(names(selection.select_files(files, pattern_input="*.py")))


def test_parameters_are_checked(files):
    with pytest.raises(ValueError, match="positive"):
        selection.select_files(files, max_size_kb=0)
    with pytest.raises(ValueError, match="pattern_mode"):
        selection.select_files(files, pattern_mode="only")


def test_size_and_name_filters_reach_the_scan(spark, files, tmp_path):
    files.drop("content").write.parquet(str(tmp_path / "m"))
    plan = selection.select_files(spark.read.parquet(str(tmp_path / "m")), 50)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,51200)" in plan and "StringContains(path,/.)" in plan


def test_kinds(files):
    found = {r.path: r.k for r in files.select("path", selection.file_kind(F.col("path"), F.col("content")).alias("k")).collect()}
    assert found["src/a.py"] == "text" and found["bin/tool.exe"] == "binary"
    assert found["data"] == "binary" and found["notes"] == "text"
    assert found["pic.png"] == "binary" and found["a.tar.gz"] == "binary" and found["a.txt.bz2"] == "text"


def test_mime_kinds_agree_with_the_library(evaluate):
    table = mimetypes.MimeTypes(filenames=())
    samples = ["x" + e for e in table.types_map[True]] + ["x" + e for e in table.suffix_map]
    samples += ["a.txt.bz2", "a.tgz", "a.svgz", "A.TXT", "a.Z", "a.txt.Z", "a.txt.z", ".txt", "..txt", "x.", "none", "a.xyz", "a.json.br", "d.txt/x"]

    def rule(path):
        mime = table.guess_type(path)[0]
        if mime is None:
            return None
        return "text" if mime.startswith("text/") or mime in ("application/json", "application/xml") else "binary"

    assert evaluate(samples, selection.mime_kind) == [rule(s) for s in samples]


def test_sniff_window(evaluate):
    values = [b"a" * 1023 + b"\x00", b"a" * 1024 + b"\x00", b"", None]
    assert evaluate(values, selection.sniff_kind, "binary") == ["binary", "text", "text", "binary"]


def test_lookup_tables_agree_with_the_expressions(files):
    joined = selection.lookup_types(files)
    assert joined.count() == files.count()
    path = F.col("path")
    checked = joined.where(
        ~selection.extension_kind(F.col("ext")).eqNullSafe(F.col("ext_kind"))
        | ~selection.mime_kind(path).eqNullSafe(F.col("mime_kind"))
    )
    assert checked.isEmpty()


def test_subdirectory(files):
    assert names(selection.subdirectory(files, "src")) == sorted([".env", "__init__.py", "a.py", "drop.log", "keep.log", "venv/lib.py"])
    assert names(selection.subdirectory(files, None, "docs/")) == ["edge.txt", "over.txt"]
    assert names(selection.subdirectory(files, "docs", "src")) == ["edge.txt", "over.txt"]
    assert selection.subdirectory(files, None).count() == files.count()
    with pytest.raises(FileNotFoundError):
        selection.require_subdirectory(files, "nowhere")


def test_rules_from_lines_and_tables_agree(spark, tmp_path):
    lines = ["# comment", "", "  *.log  ", "!keep.pyc", "build/", "*.log", "!", "#!x"]
    (tmp_path / "rules").write_text("\n".join(lines))
    parsed = Rules.of(lines)
    assert parsed == load_rules(str(tmp_path / "rules"))
    assert len(DEFAULT_PATTERNS) == 20 and load_rules(None).ignore == tuple(DEFAULT_PATTERNS)
    table = parse_rules(spark.read.text(str(tmp_path / "rules")))
    assert {(r.kind, r.pattern) for r in table.collect()} == {("ignore", p) for p in parsed.ignore} | {
        ("override", p) for p in parsed.override
    }


def test_ignore_decisions(files):
    rules = Rules.of(["build/", "notes", "*.log", "!src/keep.*", "!bin/*"])
    decided = ignore.decide(files, rules, selection.file_kind(F.col("path"), F.col("content")))
    found = {r.path: r.decision for r in decided.collect()}
    assert found["bin/tool.exe"] == "binary"
    assert found["src/keep.log"] == "override" and found["src/drop.log"] == "ignored"
    assert found["venv/lib.py"] == "ignored" and found["src/venv/lib.py"] == "kept"
    assert found["notes"] == "ignored" and found["src/a.py"] == "kept"
    assert ignore.keep(files, rules).count() + ignore.drop(files, rules).count() == files.count()


def test_newest_commit(spark):
    t = datetime.datetime
    rows = [
        ("a", "\n old \n", "x", t(2023, 1, 1), "1"), ("a", " new\n", "y", t(2023, 2, 1, 10, 20, 30), "2"),
        ("b", "first", "x", t(2023, 1, 1), "1"), ("b", "second", "y", t(2023, 1, 1), "9"),
    ]
    commits = spark.createDataFrame(rows, "path string, message string, author string, committed_at timestamp, sha string")
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    found = {r.path: r.last_commit for r in enrichment.with_last_commit(files, commits).collect()}
    assert tuple(found["a"]) == ("new", "y", "2023-02-01T10:20:30+00:00")
    assert found["b"].message == "second" and found["c"] is None


def test_export_counters(spark):
    rows = [("g", "kept", "a b\nc"), ("g", "override", ""), ("g", "kept", None), ("g", "binary", None), ("h", "ignored", "zz")]
    decided = spark.createDataFrame(rows, "source string, decision string, text string")
    found = {r.source: tuple(r)[1:] for r in stats.export_stats(decided, ["source"]).collect()}
    assert found == {"g": (2, 1, 1, 0, 5, 3, 3), "h": (0, 0, 0, 0, 0, 0, 0)}
    assert tuple(stats.export_stats(decided.limit(0)).first()) == (0,) * 7


def test_tree_prints_parents_first_and_files_before_folders(spark):
    paths = ["b.txt", "src/z.py", "src/lib/a.py", "src-x/q.py", "a/test_x.py", "src/.env", "a/b/c/d.md", "Test"]
    tree = listing.directory_tree(spark.createDataFrame([(p,) for p in paths], "path string"))
    lines = [r.line for r in tree.orderBy("sort_key").collect()]
    assert lines == [
        "└── b.txt",
        "└── a/",
        "  └── b/",
        "    └── c/",
        "      └── d.md",
        "└── src/",
        "  └── z.py",
        "  └── lib/",
        "    └── a.py",
        "└── src-x/",
        "  └── q.py",
    ]


def brute_assembly(rows, separator="\n"):
    made = {}
    for doc, *order, text in sorted(rows, key=lambda r: r[1:]):
        made.setdefault(doc, []).append(text)
    return {doc: separator.join(parts) for doc, parts in made.items()}


@pytest.mark.parametrize("bits", [1, 4, 10])
def test_assembly_has_one_rule_for_every_size(spark, bits):
    """Tiny and huge documents: the same columns, and a part for every 2**bits order values."""
    rng = random.Random(bits)
    rows = [("hot" if i % 3 == 0 else f"d{i % 40}" if i % 40 else None, i // 7, i % 7, "x" * rng.randint(0, 9) + str(i)) for i in range(1500)]
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "doc string, a bigint, b bigint, text string")
    found = assembly.assemble(lines, ["doc"], ["a", "b"], assembly.part_number(F.col("a"), bits=bits)).collect()
    pieces = {}
    for r in sorted(found, key=lambda r: (str(r.doc), r.part_no)):
        pieces.setdefault(r.doc, []).append(r)
    assert {d: "\n".join(r.text for r in p) for d, p in pieces.items()} == brute_assembly(rows)
    wanted = {(doc, a >> bits) for doc, a, _, _ in rows}
    assert {(r.doc, r.part_no) for r in found} == wanted and len(found) == len(wanted)


def test_part_numbers_rise_with_the_order(spark):
    rows = [(m, n) for m in (0, 1, 2, 300) for n in (-1, 0, 1023, 1024, 5000, 1 << 40)]
    frame = spark.createDataFrame(rows, "m bigint, n bigint").withColumn("p", assembly.part_number(F.col("n"), F.col("m")))
    found = [r.p for r in sorted(frame.collect())]
    assert found == sorted(found) and found[:4] == [0, 0, 0, 1]


def test_no_part_is_longer_than_the_limit_and_a_line(spark):
    """A slide with most of the lines, long ones among them: every line once, in order, cut by bytes."""
    rng = random.Random(5)
    rows = [("d", 1 + (i > 900), i, "é" * rng.choice([0, 1, 30, 700])) for i in range(1000)] + [("e", 1, 0, "x" * 5000), ("e", 1, 1, ""), ("f", 1, 0, "")]
    lines = spark.createDataFrame(rows, "doc string, slide_no bigint, line_no bigint, text string").repartition(4)
    parts = sorted(assembly.slide_text(lines, ["doc"], limit=2000).collect(), key=lambda r: (r.doc, r.part_no, r.cut_no))
    assert max(len(r.text.encode()) for r in parts if r.doc == "d") < 2000 + 1401
    for doc in "def":
        assert "\n".join(r.text for r in parts if r.doc == doc) == "\n".join(t for d, _, _, t in rows if d == doc)
    assert [r.cut_no for r in parts if r.doc == "e"] == [0, 2]
    plan = assembly.slide_text(lines, ["doc"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.fixture
def no_adaptive(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_per_task(frame):
    return sorted(r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect())


def test_a_hot_document_is_spread_over_the_tasks(spark, no_adaptive):
    lines = spark.range(4000).select(F.lit("hot").alias("doc"), F.col("id").alias("n"), F.lit("text").alias("text"))
    spread = rows_per_task(assembly.assemble(lines, ["doc"], ["n"], assembly.part_number(F.col("n"), bits=3)))
    assert sum(spread) == 500 and len(spread) == 4 and spread[-1] < 200


def test_a_hot_group_is_numbered_in_many_tasks(spark, no_adaptive):
    rows = spark.range(4096).select(F.lit("hot").alias("g"), (F.col("id") * 4096).alias("k"))
    spread = rows_per_task(numbering.number_rows(rows, ["g"], "k"))
    assert sum(spread) == 4096 and len(spread) >= 2 and spread[-1] < 2500


def test_slides(spark):
    rows = [("d", 1, 0, " Title "), ("d", 1, 1, "\n"), ("d", 1, 2, "Sub"), ("d", 2, 0, "a"), ("d", 2, 1, None), ("d", 3, 0, None)]
    shapes = spark.createDataFrame(rows, "path string, slide_no bigint, shape_no bigint, text string")
    lines = assembly.slide_lines(shapes, ["path"])
    text = assembly.slide_text(lines, ["path"]).first().text
    assert text == "Slide 1:\nTitle\nSub\n\nSlide 2:\na\n\nSlide 3:\n"


def workbook(spark):
    def row(sheet_no, sheet, row_no, *cells):
        return [("w.xlsx", sheet, sheet_no, row_no, i, v, t) for i, (v, t) in enumerate(cells)]

    rows = (
        row(1, "Sheet 1", 1, ("Name", "str"), ("Age", "str"), ("Notes", "str"))
        + row(1, "Sheet 1", 2, ("Jane Smith", "str"), ("25", "int"), ("VIP, priority service", "str"))
        + row(1, "Sheet 1", 3, (None, "str"), (None, "int"), (None, "str"))
        + row(1, "Sheet 1", 4, ("", "str"), (None, "int"), (None, "str"))
        + row(2, "Financial", 1, ("Q1", "str"), ("1.5e5", "float"), ("true", "bool"))
    )
    return spark.createDataFrame(
        rows, "path string, sheet string, sheet_no int, row_no bigint, col_no int, value string, vtype string"
    )


def test_sheets_as_text(spark):
    lines = assembly.sheet_lines(workbook(spark), ["path"])
    text = "\n".join(r.text for r in assembly.sheet_text(lines, ["path"]).orderBy("part_no").collect())
    assert text == (
        "Sheet: Sheet 1\n\nName | Age | Notes\nJane Smith | 25 | VIP, priority service\n\nSheet: Financial\n\nQ1 | 150000.0 | True"
    )


def test_sheets_as_csv(spark):
    lines = assembly.sheet_csv_lines(workbook(spark), ["path"]).orderBy("sheet_no", "row_no").collect()
    assert [r.text for r in lines] == ["Name,Age,Notes", 'Jane Smith,25,"VIP, priority service"', ",,", ",,", "Q1,150000.0,True"]


def test_word_documents(spark):
    none = None
    rows = [
        ("paragraph", none, none, none, 0, " Head "), ("paragraph", none, none, none, 1, "  "), ("paragraph", none, none, none, 2, "Body"),
        ("cell", 1, 0, 0, none, "Header 1"), ("cell", 1, 0, 1, none, "Header 2"),
        ("cell", 1, 1, 0, none, "Value 1"), ("cell", 1, 1, 1, none, " Value 2"),
        ("cell", 2, 0, 0, none, " "), ("cell", 2, 1, 0, none, "x"), ("cell", 2, 1, 1, none, none),
    ]
    elements = spark.createDataFrame(
        [("w", *r) for r in rows], "path string, kind string, table_no bigint, row_no bigint, col_no int, seq bigint, text string"
    )
    parts = assembly.word_text(assembly.word_lines(elements, ["path"]), ["path"]).orderBy("part_no").collect()
    text = "\n".join(r.text for r in parts)
    assert text == "Head\nBody\nHeader 1 | Header 2\nValue 1 | Value 2\nx"


def test_pages_and_selected_pages(spark):
    pages = spark.createDataFrame([("p", 1, " one "), ("p", 2, "\t"), ("p", 3, "three")], "path string, page_no bigint, text string")
    text = assembly.page_text(assembly.page_lines(pages, ["path"]), ["path"]).first().text
    assert text == "one\nthree"
    chosen = spark.createDataFrame([("p", [(2, 3), (9, 9)])], "path string, pages array<struct<low:bigint,high:bigint>>")
    some = assembly.page_lines(assembly.selected_pages(pages, chosen, ["path"]), ["path"], headed=True)
    assert some.first().text == "\n=== Page 3 ===\n\nthree"


@pytest.mark.parametrize("factor", [1, 10**13])
def test_numbering_a_hot_group(spark, factor):
    rng = random.Random(2)
    keys = [k * factor for k in rng.sample(range(-500, 100000), 2000)]
    rows = [("hot" if rng.random() < 0.6 else f"g{k % 5}" if k % 5 else None, k) for k in keys]
    found = numbering.number_rows(spark.createDataFrame(rows, "g string, k bigint"), ["g"], "k").collect()
    wanted = {}
    for g in {g for g, _ in rows}:
        wanted.update({(g, k): n for n, k in enumerate(sorted(k for h, k in rows if h == g), 1)})
    assert {(r.g, r.k): r.pos for r in found} == wanted and len(found) == len(rows)


def test_next_versions(spark):
    existing = ["out/a.txt", "out/a(1).txt", "out/a(3).txt", "out/a(x).txt", "out/b.txt", "c(2).md", "out/a.md", "d(1)(2).txt", "a.txt.bak", "e(1)z.txt"]
    wanted = ["out/a.txt", "out/a(9).txt", "out/b.txt", "c.md", "new.txt", "new(4).txt", "out/z.md", "d.txt", "a.txt", "e.txt"]
    found = versions.next_versions(
        spark.createDataFrame([(w,) for w in wanted], "path string"), spark.createDataFrame([(e,) for e in existing], "path string")
    )
    assert found.count() == len(wanted)
    assert {r.path: r.next_path for r in found.collect()} == {
        "out/a(9).txt": "out/a(4).txt", "out/a.txt": "out/a(5).txt", "out/b.txt": "out/b(1).txt", "c.md": "c(3).md",
        "new(4).txt": "new(4).txt", "new.txt": "new(5).txt", "out/z.md": "out/z.md", "d.txt": "d(1).txt", "a.txt": "a.txt", "e.txt": "e.txt",
    }


def test_a_hot_family_gets_each_number_once(spark):
    """A third of the names are of one family, half of them the same name; numbers follow the given order."""
    wanted = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, "o/hot.x").when(F.col("id") % 3 == 1, "o/hot(5).x").otherwise(F.concat(F.lit("o/f"), F.col("id").cast("string"), F.lit(".x"))).alias("path")
    )
    existing = spark.createDataFrame([("o/hot(17).x",), ("o/f2.x",)], "path string")
    found = {r.id: r.next_path for r in versions.next_versions(wanted, existing, order=["id"]).collect()}
    assert len(set(found.values())) == len(found) == 9000
    hot = [i for i in range(9000) if i % 3 < 2]
    assert [found[i] for i in hot] == [f"o/hot({18 + n}).x" for n in range(len(hot))]
    assert found[2] == "o/f2(1).x" and found[5] == "o/f5.x"


def test_a_hot_group_is_ranked_in_many_tasks(spark, no_adaptive):
    rows = spark.range(4096).select(F.lit("hot").alias("g"), F.pmod("id", F.lit(7)).alias("k"))
    ranked = numbering.rank_rows(rows, ["g"], ["k"])
    spread = rows_per_task(ranked)
    assert sum(spread) == 4096 and len(spread) >= 2 and spread[-1] < 4096
    assert sorted(r.pos for r in ranked.collect()) == list(range(1, 4097))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4  # the counts by task and group, their sums, and one join; the sort is in the staged table


def test_ranks_of_ties_nulls_and_no_rows(spark):
    rows = [("a", 2), ("a", 1), ("a", 1), (None, 5), (None, None), ("b", 7)] * 3
    frame = spark.createDataFrame(rows, "g string, k int").repartition(4)
    found = sorted(((r.g or "", r.pos, r.k if r.k is not None else -1) for r in numbering.rank_rows(frame, ["g"], ["k"]).collect()))
    assert found == [("", i + 1, k) for i, k in enumerate([-1] * 3 + [5] * 3)] + [("a", i + 1, k) for i, k in enumerate([1] * 6 + [2] * 3)] + [("b", i + 1, 7) for i in range(3)]
    assert numbering.rank_rows(frame.limit(0), ["g"], ["k"]).collect() == []
    assert sorted(r.pos for r in numbering.rank_rows(frame, [], ["g", "k"]).collect()) == list(range(1, 19))


def test_upload_rules(spark):
    big = jobs.MAX_UPLOAD_BYTES
    rows = [
        ("j", 0, "ok.txt", "text/plain", 1), ("j", 1, "x.zip", "text/plain", 1), ("j", 2, "x.exe", "text/plain", big + 1),
        ("j", 3, "x.exe", "text/plain", big), ("j", 4, "x.txt", "image/png", 1), ("j", 5, "", "text/plain", 1),
        ("j", 6, "x.pdf", None, 1), ("k", 0, "ok.PDF", "application/pdf", big),
    ]
    uploads = spark.createDataFrame(rows, "job_id string, pos bigint, filename string, content_type string, length bigint")
    checked = jobs.validate_uploads(uploads)
    assert [r.reject_reason for r in checked.orderBy("job_id", "pos").collect()] == [
        None, "Unsupported file type: .zip", "File x.exe exceeds maximum size of 50MB", "File type not allowed: .exe",
        "Invalid file type detected", "Invalid file type detected", None,
    ]
    verdicts = {r.job_id: (r.n_files, r.n_rejected, r.error) for r in jobs.request_verdicts(checked).collect()}
    assert verdicts == {"j": (6, 5, "Unsupported file type: .zip"), "k": (1, 0, None)}


def test_convertible_uploads(spark):
    rows = [("a.txt", 1024), ("b.txt", 1025), ("c.doc", 1), ("d.HTML", 1), ("skip.pdf", 1), ("noext", 1)]
    uploads = spark.createDataFrame(rows, "filename string, length bigint")
    assert names(jobs.convertible(uploads, 1, "exclude", "skip*"), "filename") == ["a.txt", "d.HTML"]
    assert names(jobs.convertible(uploads, 1, "include", "*.pdf"), "filename") == ["skip.pdf"]


def test_job_roll_ups(spark):
    def results(job, *errors):
        return [(job, n, f"f{n}.txt", e) for n, e in enumerate(errors, 1)]

    rows = results("good", None, None) + results("mixed", None, "bad", None, "worse") + results("none", "x", "y")
    frame = spark.createDataFrame(rows + results("odd", None), "job_id string, pos bigint, filename string, error string")
    known = [("good", "convert", "text"), ("mixed", "convert", "text"), ("none", "convert", "text"), ("empty", "convert", "text"), ("odd", "shred", "text"), ("gif", "convert", "gif")]
    asked = spark.createDataFrame(known, "job_id string, command string, format string")
    found = {r.job_id: (r.status, r.progress, r.n_errors) for r in jobs.job_status(asked, frame).collect()}
    assert found == {
        "good": ("completed", 100.0, 0), "mixed": ("completed_with_errors", 75.0, 2), "none": ("completed_with_errors", 0.0, 2),
        "empty": ("failed", 0.0, 0), "odd": ("failed", 0.0, 0), "gif": ("failed", 0.0, 0),
    }
    whole = {r.job_id: r.message for r in jobs.error_details(frame).collect()}
    assert whole["mixed"] == "Error converting f2.txt: bad\nError converting f4.txt: worse"
    assert jobs.error_details(frame).columns == ["job_id", "part_no", "cut_no", "message"]


def test_first_preview(spark):
    rows = [("j", 2, "b.text", "second"), ("j", 1, "a.csv", "no"), ("j", 3, "c.text", "x"), ("k", 1, "a.csv", "no")]
    outputs = spark.createDataFrame(rows, "job_id string, pos bigint, output string, text string")
    assert [tuple(r) for r in jobs.first_previews(outputs, 3).collect()] == [("j", "b.text", "sec")]


def test_route_table_agrees_with_the_expression(spark):
    from corpusloom.functions.routes import conversion_route

    pairs = [(e, f) for e in [".docx", ".xls", ".ppt", ".mht", ".htm", ".py", ".pdf", ".zip", ""] for f in ["text", "csv", "pdf", "image", "html", "docx"]]
    looked_up = jobs.lookup_routes(spark.createDataFrame(pairs, "ext string, format string"))
    assert looked_up.where(F.col("outcome") != conversion_route(F.col("ext"), F.col("format"))).isEmpty()
    assert looked_up.where("outcome is not null").count() == len(pairs)


def test_paths_sort_by_code_point(spark):
    paths = ["b", "a/b", "a-b", "a", "É", "Z", "a.b"]
    found = listing.sort_by_path(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert [r.path for r in found.collect()] == sorted(paths)
    assert PurePosixPath(paths[1]).parent.name == "a"

import datetime
import glob
import json
import os

import pytest
from corpusloom import ExportOptions, Rules, export_tree, list_tree, load_rules, read_contents
from corpusloom.functions.cells import csv_line
from corpusloom.operators import assembly, jobs, selection, stats
from corpusloom.plans.export import decided_files, tree_files
from corpusloom.session import cut_lineage, shared_folder, stage
from corpusloom.sinks import documents, json_export, text_export
from corpusloom.sources.tables import SCHEMAS, read_table
from corpusloom.streaming import ingest, status
from pyspark.sql import functions as F


def write(root, path, content):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as out:
        out.write(content)


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "project")
    for path, content in {
        "hello.txt": b"Hello, World!",
        "__init__.py": b"",
        "_priv/x.txt": b"private\r\nlines\r",
        "src/main.py": "print('é')\n".encode(),
        "src/test_main.py": b"assert 1\n",
        "src/lib/deep/util.py": b"x = 1",
        ".git/config": b"[core]",
        ".gitignore": b"# rules\n*.log\nsecret/*\n!secret/ok.txt\n",
        "run.log": b"log",
        "secret/no.txt": b"no",
        "secret/ok.txt": b"ok",
        "binary.dat": b"\x00\x01\x02\x03",
        "bad.txt": b"\xff\xfe",
        "big.txt": b"b" * 51201,
        "edge.txt": b"e" * 51200,
    }.items():
        write(root, path, content)
    os.symlink(root, os.path.join(root, "src", "loop"))
    return root


def test_listing_keeps_underscores_and_empty_files(spark, tree):
    found = {r.path: r.length for r in list_tree(spark, tree).collect()}
    assert found["__init__.py"] == 0 and found["_priv/x.txt"] == 15 and found["src/lib/deep/util.py"] == 5
    assert not any(p.startswith(".") or "loop" in p for p in found) and len(found) == 13
    assert ".git/config" in {r.path for r in list_tree(spark, tree, hidden=True).collect()}


def test_odd_names_and_relative_roots(spark, tmp_path, monkeypatch):
    odd = ["a b.txt", "per%20cent.txt", "new\nline.txt", "quo'te\".txt", "é/ü#?.txt", "-/--.txt"]
    for name in odd:
        write(str(tmp_path / "my #1 %41 project"), name, name.encode())
    monkeypatch.chdir(tmp_path)
    for root in (str(tmp_path / "my #1 %41 project"), "my #1 %41 project"):
        found = read_contents(list_tree(spark, root), root)
        assert {r.path: bytes(r.content).decode() for r in found.collect()} == {n: n for n in odd}
    uri = (tmp_path / "my #1 %41 project").as_uri()
    assert list_tree(spark, uri).count() == len(odd)


def test_listing_errors(spark, tree):
    with pytest.raises(FileNotFoundError):
        list_tree(spark, tree + "/nowhere")
    with pytest.raises(NotADirectoryError):
        list_tree(spark, tree + "/hello.txt")


def test_reading_contents(spark, tree):
    manifest = list_tree(spark, tree).where("length < 100")
    found = {r.path: bytes(r.content) for r in read_contents(manifest, tree).collect()}
    assert found["hello.txt"] == b"Hello, World!" and found["__init__.py"] == b"" and "big.txt" not in found
    assert read_contents(manifest, tree, bytes_per_task=10).rdd.getNumPartitions() > 6
    gone = spark.createDataFrame([("missing.txt", 5)], "path string, length bigint")
    row = read_contents(gone, tree).first()
    assert row.content is None and row.read_error is None


def test_a_file_that_cannot_be_read_is_an_error(spark, tree):
    """A folder listed as a file stands in for a store that refuses a read."""
    manifest = spark.createDataFrame([("src", 1, None), ("hello.txt", 1, None)], "path string, length bigint, modified timestamp")
    found = read_contents(manifest, tree)
    assert {r.path: r.read_error is None for r in found.collect()} == {"src": False, "hello.txt": True}
    totals = stats.export_stats(decided_files(found, ExportOptions())).first()
    assert (totals.processed_files, totals.binary_files, totals.error_files) == (1, 0, 1)


def joined(folder):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{folder}/part-*")))


def commits_for(spark, *paths):
    at = datetime.datetime(2023, 1, 1)
    return spark.createDataFrame(
        [(p, "Initial commit\n", "Test Author", at, "1") for p in paths],
        "path string, message string, author string, committed_at timestamp, sha string",
    )


def test_only_files_that_matter_are_opened(spark, tree):
    write(tree, "pic.png", b"png")
    write(tree, "node_modules/a.js", b"x")
    options = ExportOptions(max_size_kb=50, rules=load_rules(tree + "/.gitignore"))
    opened = {r.path for r in tree_files(spark, tree, options).where("content is not null").collect()}
    assert opened == {
        "hello.txt", "__init__.py", "_priv/x.txt", "src/main.py", "src/test_main.py", "src/lib/deep/util.py",
        "secret/ok.txt", "binary.dat", "bad.txt", "edge.txt", "run.log",
    }
    every = read_contents(list_tree(spark, tree), tree)
    some, whole = (decided_files(f, options).select("path", "decision", "text") for f in (tree_files(spark, tree, options), every))
    assert sorted(map(repr, some.collect())) == sorted(map(repr, whole.collect()))


def test_text_export_of_a_tree(spark, tree, tmp_path):
    options = ExportOptions(max_size_kb=50)
    out = str(tmp_path / "out")
    totals = export_tree(spark, tree, out, options, commits=commits_for(spark, "hello.txt"))
    rule, thin = "=" * 80, "-" * 80

    def block(path, text, commit="No commits found"):
        return f"File: {tree}/{path}\n{thin}\nLast Commit: {commit}\n\n{text}\n{rule}\n\n"

    wanted = (
        f"Generated by corpusloom\n{rule}\n\nRepository: project\n\nDirectory Structure:\n------------------\n"
        "└── __init__.py\n└── bad.txt\n└── edge.txt\n└── hello.txt\n└── _priv/\n  └── x.txt\n└── secret/\n  └── ok.txt\n"
        "└── src/\n  └── main.py\n  └── lib/\n    └── deep/\n      └── util.py\n"
        f"\n{rule}\n\n"
        + block("__init__.py", "")
        + block("_priv/x.txt", "private\nlines\n")
        + block("edge.txt", "e" * 51200)
        + block("hello.txt", "Hello, World!", "Initial commit by Test Author on 2023-01-01")
        + block("secret/ok.txt", "ok")
        + block("src/lib/deep/util.py", "x = 1")
        + block("src/main.py", "print('é')\n")
        + block("src/test_main.py", "assert 1\n")
        + "\nFile Statistics:\n--------------\nTotal files processed: 8\nBinary files skipped: 1\nFiles with errors: 0\n"
        "Total characters: 51,254\nTotal lines: 12\nTotal tokens: 12\n"
    )
    assert joined(out) == wanted
    assert tuple(totals.first()) == (8, 1, 1, 0, 51254, 12, 12)


def test_json_export_of_a_tree(spark, tree, tmp_path):
    options = ExportOptions(repository="pro\"ject", subdir="src", pattern_mode="include", pattern_input="*.py")
    out = str(tmp_path / "out")
    export_tree(spark, tree, out, options, fmt="json", commits=commits_for(spark, "main.py"))
    document = json.loads(joined(out))
    assert document == {
        "repository": 'pro"ject',
        "files": [
            {"path": "lib/deep/util.py", "content": "x = 1", "last_commit": None},
            {
                "path": "main.py",
                "content": "print('é')\n",
                "last_commit": {"message": "Initial commit", "author": "Test Author", "date": "2023-01-01T00:00:00+00:00"},
            },
            {"path": "test_main.py", "content": "assert 1\n", "last_commit": None},
        ],
    }


def test_json_lines_and_empty_documents(spark, tree, tmp_path):
    options = ExportOptions(repository="project", subdir="src/lib")
    export_tree(spark, tree, str(tmp_path / "lines"), options, fmt="jsonl")
    files = glob.glob(str(tmp_path / "lines/repository=project/part-*"))
    rows = [json.loads(line) for p in files for line in open(p, encoding="utf-8")]
    assert rows == [{"path": "deep/util.py", "content": "x = 1", "last_commit": None}]
    nothing = ExportOptions(repository="project", pattern_mode="include", pattern_input="*.nope")
    export_tree(spark, tree, str(tmp_path / "none"), nothing, fmt="json")
    assert json.loads(joined(str(tmp_path / "none"))) == {"repository": "project", "files": []}
    with pytest.raises(ValueError, match="Unknown format"):
        export_tree(spark, tree, str(tmp_path / "x"), nothing, fmt="pdf")


def test_export_without_commits(spark, tmp_path):
    decided = spark.createDataFrame([("a", "kept", "t", 1), ("b", "kept", None, 1)], "path string, decision string, text string, length bigint")
    blocks = text_export.text_export(decided, "r").where("section = 2").collect()
    assert [b.block for b in blocks] == [f"File: a\n{'-' * 80}\nt\n{'=' * 80}\n"]
    assert json_export.json_entries(decided, "r").first().last_commit is None


def test_document_texts_one_folder_per_name(spark, tmp_path):
    rows = [("hot" if i % 3 else f"d{i % 5}", i, f"line {i}") for i in range(900)]
    lines = spark.createDataFrame(rows, "name string, n bigint, text string").repartition(8, "n")
    documents.write_document_texts(lines, "name", ["n"], str(tmp_path / "o"), partitions=6)
    for name in {r[0] for r in rows}:
        assert joined(f"{tmp_path}/o/name={name}") == "".join(f"{t}\n" for d, _, t in rows if d == name)
    assert len(glob.glob(f"{tmp_path}/o/name=hot/part-*")) > 1


def test_sheets_as_csv_files(spark, tmp_path):
    rows = spark.createDataFrame([("My Sheet", "a,b", 'say "x"'), ("Other", "1", None)], "sheet string, c1 string, c2 string")
    documents.write_sheet_csv(rows, "sheet", str(tmp_path / "wide"))
    assert sorted(os.path.basename(p) for p in glob.glob(f"{tmp_path}/wide/sheet=*")) == ["sheet=My_Sheet", "sheet=Other"]
    back = spark.read.schema("c1 string, c2 string").option("escape", "\\").csv(f"{tmp_path}/wide/sheet=My_Sheet")
    assert tuple(back.first()) == ("a,b", 'say "x"')
    cells = spark.createDataFrame(
        [("b.xlsx", "My Sheet", 1, 2, 1, "x,y", "str"), ("b.xlsx", "My Sheet", 1, 1, 1, "h", "str")],
        "path string, sheet string, sheet_no int, row_no bigint, col_no int, value string, vtype string",
    )
    documents.write_csv_lines(assembly.sheet_csv_lines(cells, ["path"]), "path", str(tmp_path / "lines"))
    assert joined(f"{tmp_path}/lines/file=b_My_Sheet.csv") == 'h\n"x,y"\n'
    assert spark.range(1).select(csv_line(F.array(F.lit("a"), F.lit(None)))).first()[0] == "a,"


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert folder in shared_folder(spark)
    assert cut_lineage(spark.range(3)).count() == 3
    assert stage(spark.range(3)).inputFiles()[0].split("stage-")[0].rstrip("/").endswith(shared_folder(spark).removeprefix("file:"))


def test_fixed_schemas(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "path string, length bigint").write.parquet(str(tmp_path / "m"))
    assert read_table(spark, "manifest", str(tmp_path / "m")).schema.fieldNames() == ["path", "length", "modified"]
    assert all(spark.createDataFrame([], schema).schema for schema in SCHEMAS.values())


def test_ingest_of_arriving_files_equals_the_batch(spark, tmp_path):
    landing, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    write(landing, "a/one.txt", b"one two\nthree")
    write(landing, "a/big.txt", b"x" * 3000)
    write(landing, "a/pic.jpg", b"\xff\xd8\x00")
    write(landing, "venv/x.txt", b"text")
    write(landing, "a/data", b"\x00\x01")
    stream = ingest.measured_files(ingest.landing_files(spark, landing), max_size_kb=2)
    ingest.append_batches(stream, out, state).awaitTermination()
    write(landing, "b/two.txt", b"\xe9t\xe9")
    for _ in range(2):
        stream = ingest.measured_files(ingest.landing_files(spark, landing), max_size_kb=2)
        ingest.append_batches(stream, out, state).awaitTermination()
    found = {r.path: (r.chars, r.lines, r.tokens, r.text) for r in spark.read.parquet(out).collect()}
    nothing = (None, None, None, None)
    assert found == {"a/one.txt": (13, 2, 3, "one two\nthree"), "b/two.txt": (3, 1, 1, "été"), "a/pic.jpg": nothing, "venv/x.txt": nothing, "a/data": nothing}
    assert {r.path: r.decision for r in spark.read.parquet(out).collect()} == {
        "a/one.txt": "kept", "b/two.txt": "kept", "a/pic.jpg": "binary", "venv/x.txt": "ignored", "a/data": "binary",
    }
    batch = stats.measure(selection.select_files(list_tree(spark, landing), 2).withColumn("text", F.lit("")))
    assert {r.path for r in batch.collect()} == set(found)


@pytest.mark.parametrize("form", ["{0}", "file:{0}", "file://{0}/"])
def test_landing_paths_are_relative_however_the_zone_is_named(spark, tmp_path, form):
    landing = str(tmp_path / "a zone")
    write(landing, "x/y z.txt", b"one")
    ingest.append_batches(ingest.landing_files(spark, form.format(landing)), str(tmp_path / "o"), str(tmp_path / "s")).awaitTermination()
    assert [r.path for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["x/y z.txt"]


def test_repeated_batches_replace_themselves(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(landing, "a.txt", b"one")
    for attempt in ("first", "second"):
        stream = ingest.landing_files(spark, landing)
        ingest.append_batches(stream, out, str(tmp_path / attempt)).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_running_status_equals_the_batch(spark, tmp_path):
    schema = "job_id string, pos bigint, filename string, error string, output string, ts timestamp"
    landing, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))

    def arrive(*rows):
        made = [(j, p, f"f{p}", e, None, None) for j, p, e in rows]
        spark.createDataFrame(made, schema).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        status.track_jobs(stream, out, state).awaitTermination()

    total = spark.createDataFrame([("a", 3), ("b", 1)], "job_id string, n_total bigint")
    arrive(("a", 1, None), ("a", 2, "bad"), ("b", 1, None))
    first = {r.job_id: (r.status, r.progress) for r in status.latest_status(spark, out, total).collect()}
    assert first["a"][0] == "processing" and round(first["a"][1], 3) == 33.333 and first["b"] == ("completed", 100.0)
    arrive(("a", 3, None))
    last = {r.job_id: (r.n_files, r.n_errors, r.last_ok) for r in status.latest_status(spark, out).collect()}
    batch = {r.job_id: (r.n_files, r.n_errors, r.last_ok) for r in jobs.job_counts(spark.read.schema(schema).parquet(landing)).collect()}
    assert last == batch == {"a": (3, 1, 3), "b": (1, 0, 1)}
    assert {r.job_id: r.status for r in status.latest_status(spark, out, total).collect()}["a"] == "completed_with_errors"


def test_default_rules_apply_without_a_rule_file(tree):
    assert load_rules(tree + "/nowhere") == load_rules(None) == Rules()
    assert "venv/*" in Rules().ignore and Rules().override == ()
    write(tree, "odd/.gitignore", b"*.x\xff\n")
    with pytest.warns(UserWarning, match="Error reading"):
        assert load_rules(tree + "/odd/.gitignore") == Rules()
    write(tree, "lines/.gitignore", "a\x0cb\r\nc\rd".encode())
    assert load_rules(tree + "/lines/.gitignore").ignore[-3:] == ("a\x0cb", "c", "d")

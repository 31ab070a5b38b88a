"""Ranged reads, the tree data source, files by a committing writer, and the table of current jobs."""

import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from corpusloom import ExportOptions, Rules
from corpusloom.operators import segments
from corpusloom.operators.jobs import job_counts
from corpusloom.plans.export import decided_files, tree_files
from corpusloom.plans.export_many import export_repositories
from corpusloom.sinks.files import safe_name, write_files
from corpusloom.sources.tree import list_tree, read_contents, read_heads, read_segments
from corpusloom.sources.tree_source import tree_stream, tree_table
from corpusloom.streaming import current, uploads
from corpusloom.streaming.ingest import append_batches


def write(root, path, content):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as out:
        out.write(content)


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "tree")
    for path, content in {
        "a.txt": b"plain text\n" * 300, "b.dat": b"\x00" + b"x" * 500_000, "c.xyz": b"words " * 5000, "d.png": b"p" * 90_000, "e": b"", "_f/g.unknown": b"small",
        "skip/h.xyz": b"y" * 70_000, ".hidden/i.txt": b"no", "_f/.j": b"dot", "k/l/m/n.py": b"print()\n",
    }.items():
        write(root, path, content)
    return root


# --- ranged reads ----------------------------------------------------------------------


def counting(log):
    """An opener of a file system that notes how many bytes of each file were read; all of it travels to the workers by value."""

    def opener(root):
        import json
        import os

        import pyarrow.fs as pafs

        class Reader:
            def __init__(self, path, stream):
                self.path, self.stream = path, stream

            def __enter__(self):
                return self

            def __exit__(self, *_):
                self.stream.close()

            def seek(self, at):
                self.stream.seek(at)

            def read(self, size=None):
                data = self.stream.read(size)
                with open(log, "a") as out:
                    out.write(json.dumps([os.path.basename(self.path), len(data)]) + "\n")
                return data

        class Counting:
            fs = pafs.LocalFileSystem()

            def open_input_stream(self, path):
                return Reader(path, self.fs.open_input_stream(path))

            def open_input_file(self, path):
                return Reader(path, self.fs.open_input_file(path))

        return Counting(), root

    return opener


def bytes_read(log):
    found = {}
    for line in open(log):
        name, n = json.loads(line)
        found[name] = found.get(name, 0) + n
    return found


def test_sniffing_reads_one_kilobyte(spark, tree, tmp_path):
    log = str(tmp_path / "log")
    options = ExportOptions(rules=Rules.of(["skip/*"]))
    rows = decided_files(tree_files(spark, tree, options, opener=counting(log)), options).select("path", "decision", F.length("text").alias("n")).collect()
    assert bytes_read(log) == {"a.txt": 3300, "b.dat": 1024, "c.xyz": 1024 + 30_000, "e": 0, "g.unknown": 5, "h.xyz": 1024, "n.py": 8}
    assert {r.path: (r.decision, r.n) for r in rows} == {
        "a.txt": ("kept", 3300), "b.dat": ("binary", None), "c.xyz": ("kept", 30_000), "d.png": ("binary", None), "e": ("kept", 0),
        "_f/g.unknown": ("kept", 5), "skip/h.xyz": ("ignored", None), "k/l/m/n.py": ("kept", 8),
    }


def test_heads_and_segments(spark, tree):
    manifest = list_tree(spark, tree)
    heads = {r.path: bytes(r["head"]) for r in read_heads(manifest, tree, 4).collect()}
    assert heads["a.txt"] == b"plai" and heads["e"] == b"" and heads["b.dat"] == b"\x00xxx"
    parts = read_segments(manifest, tree, segment_bytes=999)
    assert parts.rdd.getNumPartitions() >= 1
    whole = {}
    for r in sorted(parts.collect(), key=lambda r: r.segment):
        assert len(r.content) <= 999 and r.read_error is None
        whole[r.path] = whole.get(r.path, b"") + bytes(r.content)
    assert whole == {r.path: bytes(r.content) for r in read_contents(manifest, tree).collect()}
    gone = spark.createDataFrame([("missing", 5, None)], "path string, length bigint, modified timestamp")
    assert [(r.content, r.read_error) for r in read_segments(gone, tree).collect()] == [(None, None)]


def test_measures_of_files_in_ranges(spark, tmp_path):
    root = str(tmp_path / "big")
    texts = {"a": "wörd \r\n日本 x\r" * 700, "b": "", "c": "one"}
    for name, text in texts.items():
        write(root, name, text.encode())
    write(root, "bad", b"ok \xff")
    parts = read_segments(list_tree(spark, root), root, segment_bytes=101)
    found = {r.path: (r.chars, r.lines, r.tokens) for r in segments.segment_metrics(parts, ["path"]).collect()}
    plain = {n: t.replace("\r\n", "\n").replace("\r", "\n") for n, t in texts.items()}
    assert found == {**{n: (len(t), t.count("\n") + 1, len(t.split())) for n, t in plain.items()}, "bad": (None, None, None)}


# --- the tree as a data source ---------------------------------------------------------


def test_tree_source_equals_the_listing(spark, tree):
    listed = sorted(list_tree(spark, tree, hidden=True).select("path", "length").collect())
    for options in ({}, {"folders": 1}, {"folders": 3}, {"entries_per_task": 1}, {"entries_per_task": 2, "folders": 100}):
        assert sorted(tree_table(spark, tree, **options).select("path", "length").collect()) == listed
    assert sorted(tree_table(spark, tree, hidden="false").select("path", "length").collect()) == sorted(list_tree(spark, tree).select("path", "length").collect())
    assert tree_table(spark, tree, entries_per_task=1).rdd.getNumPartitions() > 8
    modified = {r.path: r.modified for r in tree_table(spark, tree).collect()}
    assert modified == {r.path: r.modified for r in list_tree(spark, tree, hidden=True).collect()}


def test_tree_source_errors(spark, tree):
    for bad in (tree + "/nowhere", tree + "/a.txt"):
        with pytest.raises(Exception, match="irectory"):
            tree_table(spark, bad).collect()


def test_tree_stream_equals_the_listing(spark, tree, tmp_path):
    """Two runs of a stream: what was there, then what came; dot names, empty files and ``_names`` among it."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        append_batches(tree_stream(spark, tree, delay_seconds=0), out, state).awaitTermination()
        return [r.path for r in spark.read.parquet(out).collect()]

    first = run()
    assert sorted(first) == sorted(r.path for r in list_tree(spark, tree, hidden=True).collect())
    time.sleep(0.05)
    write(tree, "_new/__init__.py", b"")
    write(tree, ".late", b"x")
    second = run()
    assert sorted(second) == sorted([*first, "_new/__init__.py", ".late"])


# --- files by a committing writer ------------------------------------------------------


def tree_of(folder):
    return {os.path.relpath(p, folder): open(p).read() for p in glob.glob(f"{folder}/**/*", recursive=True, include_hidden=True) if os.path.isfile(p)}


def test_one_file_for_each_output(spark, tmp_path):
    lines = spark.range(30_000).select(
        F.concat(F.lit("d"), (F.col("id") % 7).cast("string"), F.lit("/f"), (F.col("id") % 10_000).cast("string"), F.lit(".text")).alias("file"),
        "id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"),
    )
    folder = str(tmp_path / "out")
    write_files(lines, "file", ["id"], folder, partitions=6)
    found = tree_of(folder)
    expected = {}
    for i in range(30_000):
        expected.setdefault(f"d{i % 7}/f{i % 10_000}.text", []).append(f"line {i}\n")
    assert found == {name: "".join(text) for name, text in expected.items()}


def test_outputs_are_replaced_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 0, "é"), ("b c.text", 0, ""), (None, 0, "no"), ("d", 0, None)], "file string, at int, text string")
    write_files(rows, "file", ["at"], folder)
    assert tree_of(folder) == {"a": "é\nx\n", "b c.text": "\n", "d": "\n"}
    write_files(rows.where("file = 'a' and at = 1"), "file", ["at"], folder)
    assert tree_of(folder) == {"a": "x\n", "b c.text": "\n", "d": "\n"}
    write_files(rows.limit(0), "file", ["at"], str(tmp_path / "none"))
    assert tree_of(str(tmp_path / "none")) == {}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    write_files(spark.createDataFrame([("keep", 0, "x")], "file string, at int, text string"), "file", ["at"], folder)
    failing = spark.range(200).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.col("id").alias("at"),
        F.when(F.col("id") == 150, F.raise_error(F.lit("broken")).cast("string")).otherwise("text").alias("text"),
    )
    with pytest.raises(Exception, match="broken"):
        write_files(failing, "file", ["at"], folder, partitions=4)
    assert tree_of(folder) == {"keep": "x\n"}
    assert os.listdir(folder) == ["keep"]


def test_names_stay_below_the_folder(spark, tmp_path):
    assert safe_name("/a//./b") == "a/b"
    for bad in ("../x", "a/../../b", "", "/"):
        with pytest.raises(ValueError):
            safe_name(bad)
    with pytest.raises(Exception, match="not a file below"):
        write_files(spark.createDataFrame([("../x", 0, "x")], "file string, at int, text string"), "file", ["at"], str(tmp_path / "o"))
    assert not (tmp_path / "x").exists()


# --- many repositories -----------------------------------------------------------------


def test_many_repositories_are_written_apart(spark, tmp_path):
    files = [("one", "a.txt", "A"), ("one", "b.log", "B"), ("one", "src/c.py", "C"), ("two", "a.txt", "D"), ("two", "b.log", "E"), ("three", "x.bin", "F")]
    frame = spark.createDataFrame([(r, p, len(t), bytearray(t.encode())) for r, p, t in files], "repository string, path string, length bigint, content binary")
    lines = spark.createDataFrame([("one", "*.log"), ("two", "*.txt"), ("two", "!b*")], "repository string, value string")
    commits = spark.createDataFrame([("one", "a.txt", " m \n", "au", "1"), ("two", "a.txt", "n", "au", "2")], "repository string, path string, message string, author string, sha string")
    commits = commits.withColumn("committed_at", F.to_timestamp(F.lit("2023-01-01")))
    totals = {r.repository: r for r in export_repositories(frame, lines, str(tmp_path / "text"), commits=commits).collect()}
    assert {k: (v.processed_files, v.binary_files) for k, v in totals.items()} == {"one": (2, 0), "two": (1, 0), "three": (0, 1)}

    def text(name):
        return "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/text/repository={name}/part-*")))

    assert "File: a.txt" in text("one") and "Last Commit: m by au on 2023-01-01" in text("one") and "b.log" not in text("one")
    assert "└── src/\n  └── c.py" in text("one") and text("one").index("Repository: one") < text("one").index("File: src/c.py") < text("one").index("Total files processed: 2")
    assert "File: b.log" in text("two") and "a.txt" not in text("two")
    assert "Total files processed: 0\nBinary files skipped: 1" in text("three")
    export_repositories(frame, lines, str(tmp_path / "json"), fmt="jsonl")
    entries = spark.read.json(str(tmp_path / "json")).select("repository", "path", "content").collect()
    assert sorted(map(tuple, entries)) == [("one", "a.txt", "A"), ("one", "src/c.py", "C"), ("two", "b.log", "E")]
    with pytest.raises(ValueError):
        export_repositories(frame, lines, str(tmp_path / "x"), fmt="xml")


# --- current jobs ----------------------------------------------------------------------


def results(spark, *rows):
    frame = spark.createDataFrame(list(rows), "job_id string, pos bigint, error string, t string")
    return frame.select("job_id", "pos", "error", F.to_timestamp("t").alias("ts"))


def tables(spark, folder):
    now = {r.job_id: (r.n_files, r.n_errors, r.last_ok, r.status) for r in current.current_jobs(spark, folder).collect()}
    ended = {r.job_id: (r.n_files, r.n_errors, r.last_ok, r.status) for r in current.finished_jobs(spark, folder).collect()}
    return now, ended


def test_jobs_leave_the_table_when_they_end(spark, tmp_path):
    folder = str(tmp_path / "jobs")
    totals = spark.createDataFrame([("a", 2), ("b", 5)], "job_id string, n_total bigint")
    current.start_table(spark, folder)
    current.merge_batch(results(spark, ("a", 1, None, "2024-01-01 10:00"), ("b", 1, "x", "2024-01-01 10:00"), ("c", 1, None, "2024-01-01 10:01")), 0, folder, "1 hour", totals)
    assert tables(spark, folder) == ({"a": (1, 0, 1, "processing"), "b": (1, 1, 0, "processing"), "c": (1, 0, 1, "processing")}, {})
    second = results(spark, ("a", 2, None, "2024-01-01 10:02"), ("b", 2, None, "2024-01-01 11:02"))
    for _ in range(2):  # a repeated batch changes nothing
        current.merge_batch(second, 1, folder, "1 hour", totals)
        assert tables(spark, folder) == ({"b": (2, 1, 2, "processing")}, {"a": (2, 0, 2, "completed"), "c": (1, 0, 1, "completed")})
    # a late result opens a finished job again, with all that it had
    current.merge_batch(results(spark, ("c", 2, "late", "2024-01-01 09:00"), ("d", 7, None, "2024-01-01 11:30")), 2, folder, "1 day", totals)
    now, ended = tables(spark, folder)
    assert now["c"] == (2, 1, 1, "processing") and now["d"] == (1, 0, 7, "processing") and "c" not in ended
    current.merge_batch(results(spark, ("d", 8, None, "2024-01-09 00:00")), 3, folder, "1 day", totals)
    now, ended = tables(spark, folder)
    assert now == {"d": (2, 0, 8, "processing")}  # state after expiry: the open jobs alone
    assert ended["c"] == (2, 1, 1, "completed_with_errors") and ended["b"] == (2, 1, 2, "completed_with_errors")
    assert sorted(os.listdir(f"{folder}/open")) == ["version=-1", "version=2", "version=3"]  # older ones are removed


def test_a_stream_of_batches_ends_as_one_batch(spark, tmp_path):
    source, folder, state = (str(tmp_path / x) for x in ("source", "jobs", "state"))
    rows = results(spark, *[(f"j{i % 9}", i, "bad" if i % 11 == 0 else None, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00") for i in range(240)])
    for day in range(5):
        rows.where((F.dayofmonth("ts") - 1) % 5 == day).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        current.follow_jobs(stream, folder, state, "36 hours").awaitTermination()
    now, ended = tables(spark, folder)
    counts = {r.job_id: (r.n_files, r.n_errors, r.last_ok) for r in job_counts(rows).collect()}
    assert {job: row[:3] for job, row in {**now, **ended}.items()} == counts and not set(now) & set(ended)


def test_verdicts_fall_when_all_is_there_or_late(spark, tmp_path):
    """Requests and uploads in any order, over three runs of the streams."""
    asked, sent, folder, state = (str(tmp_path / x) for x in ("asked", "sent", "table", "state"))

    def request(*rows):
        spark.createDataFrame(list(rows), "job_id string, n_files bigint, t string").select("job_id", "n_files", F.to_timestamp("t").alias("ts")).write.mode("append").parquet(asked)

    def upload(*rows):
        frame = spark.createDataFrame(list(rows), "job_id string, pos bigint, filename string, content_type string, length bigint, t string")
        frame.withColumn("ts", F.to_timestamp("t")).drop("t").write.mode("append").parquet(sent)

    def run():
        a, b = (spark.readStream.schema(spark.read.parquet(x).schema).parquet(x) for x in (asked, sent))
        uploads.follow_requests(a, b, folder, state, "1 hour").awaitTermination()
        fallen = {r.job_id: (r.n_files, r.n_rejected, r.error, r.complete) for r in uploads.verdicts(spark, folder).collect()}
        return fallen, {r.job_id: (r.announced, r.n_files) for r in uploads.open_requests(spark, folder).collect()}

    request(("a", 2, "2024-01-01 10:00"), ("b", 3, "2024-01-01 10:00"))
    upload(("a", 2, "x.exe", "text/plain", 1, "2024-01-01 10:01"), ("a", 1, "y.zip", "text/plain", 1, "2024-01-01 10:02"), ("b", 0, "ok.txt", "text/plain", 1, "2024-01-01 10:03"), ("c", 0, "early.txt", "text/plain", 1, "2024-01-01 10:05"), ("b", 9, "", "text/plain", 1, "2024-01-01 10:03"))
    assert run() == ({"a": (2, 2, "Unsupported file type: .zip", True)}, {"b": (3, 1), "c": (None, 1)})
    request(("c", 1, "2024-01-01 10:30"))
    upload(("d", 0, "z.txt", "text/plain", 1, "2024-01-01 11:20"))
    fallen, waiting = run()
    assert fallen["c"] == (1, 0, None, True) and fallen["b"] == (1, 0, None, False)  # b was late
    assert waiting == {"d": (None, 1)}
    upload(("b", 1, "late.py", "text/plain", 1, "2024-01-01 10:10"), ("b", 2, "late.txt", "text/plain", 1, "2024-01-01 10:11"))
    fallen, _ = run()
    assert fallen["b"] == (3, 1, "File type not allowed: .py", True)

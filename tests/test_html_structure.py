"""Nested tables, lists and image references of web pages."""

from pyspark.sql import functions as F

from corpusloom.functions.html import normalized_path
from corpusloom.operators import html_structure as structure


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page int, html string").repartition(2)


def cells(spark, *html):
    rows = structure.table_cells(pages(spark, *html), ["page"]).collect()
    return sorted((r.page, r.table_no, r.outer_table, r.row_no, r.col_no, r.kind, r.text) for r in rows)


def test_cells_around_a_nested_table(spark):
    found = cells(spark, "<table><tr><td>a<table><tr><td>x</td></tr></table></td><td>b</td></tr></table>")
    assert found == [(0, 1, 0, 1, 1, "td", "a"), (0, 1, 0, 1, 2, "td", "b"), (0, 2, 1, 1, 1, "td", "x")]


def test_three_levels_and_a_neighbour(spark):
    found = cells(spark, "<table><tr><td>1<table><tr><td>2<table><tr><th>3</th></tr></table>2b</table>1b<tr><td>1c</table> between <table><td>4</table>")
    assert found == [
        (0, 1, 0, 1, 1, "td", "11b"), (0, 1, 0, 2, 1, "td", "1c"), (0, 2, 1, 1, 1, "td", "22b"), (0, 3, 2, 1, 1, "th", "3"), (0, 4, 0, 1, 1, "td", "4"),
    ]


def test_two_nested_tables_share_the_outer_one(spark):
    found = cells(spark, "<table><tr><td><table><td>x</table><td><table><td>y</table></table>")
    assert [(t, u, r, c, x) for _, t, u, r, c, _, x in found] == [(1, 0, 1, 1, ""), (1, 0, 1, 2, ""), (2, 1, 1, 1, "x"), (3, 1, 1, 1, "y")]


def test_open_ends_and_strays(spark):
    html = ["</table><td>lost<table><tr><td>a<td>b<tr><tr><td>c &lt;d&gt;<!-- <td>no --></td>stray</tr>out</table>after", "no table", None, "<TABLE a='<td>'><TR><TD B=1>x", ""]
    assert cells(spark, *html) == [(0, 1, 0, 1, 1, "td", "a"), (0, 1, 0, 1, 2, "td", "b"), (0, 1, 0, 2, 1, "td", "c <d>"), (3, 1, 0, 1, 1, "td", "x")]


def test_equal_pages_stay_apart(spark):
    frame = spark.createDataFrame([(1, "<table><td>a</table>"), (1, "<table><td>a</table>")], "page int, html string")
    assert len(structure.table_cells(frame, ["page"]).collect()) == 2


def test_rows_as_text(spark):
    found = structure.table_rows(structure.table_cells(pages(spark, "<table><tr><th>h<th>i<tr><td> x <b>y</b> <td></table>"), ["page"]), ["page"])
    assert sorted((r.row_no, r.text) for r in found.collect()) == [(1, "h | i"), (2, "x y | ")]


def test_nested_lists(spark):
    html = "<li>none<ul><li>a<ol><li>b</li>x<li>c<ul><li>d</ul></ol>e<li>f</ul><ol></ol>"
    rows = structure.list_items(pages(spark, html), ["page"]).collect()
    assert sorted((r.list_no, r.outer_list, r.depth, r.item_no, r.text) for r in rows) == [
        (1, 0, 1, 1, "ae"), (1, 0, 1, 2, "f"), (2, 1, 2, 1, "b"), (2, 1, 2, 2, "c"), (3, 2, 3, 1, "d"),
    ]


def test_windows_share_one_exchange_of_the_tags(spark):
    plan = structure.table_cells(pages(spark, "<table><td>a</table>"), ["page"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_tasks_follow_the_bytes_of_the_pages(spark, monkeypatch):
    """Markup that compresses well is dealt by what it holds, and pages without an equal key stay apart."""
    monkeypatch.setattr(structure, "TASK_BYTES", 4000, raising=False)
    frame = spark.range(300).select((F.col("id") % 2).alias("page"), F.repeat(F.lit("<ul><li>a<ol><li>b</ol></ul>"), 10).alias("html"))
    for rows in (structure.list_items(frame, ["page"]), structure.table_cells(frame.withColumn("html", F.lit("<table><td>a</table>" * 15)), ["page"])):
        found = rows.withColumn("task", F.spark_partition_id()).collect()
        assert len({r.task for r in found}) >= 20
        assert len(found) in (300 * 20, 300 * 15)


def test_dot_segments(spark):
    paths = {
        "a/b": "a/b", "a/./b": "a/b", "a//b/": "a/b", "a/../b": "b", "a/b/../../c": "c", "..": None, "a/../../b": None, "../a": None, ".": "", "a/..": "",
        "a/../../b/c/d": None, ".../x": ".../x",
    }
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", normalized_path(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in rows} == paths


def test_images_against_the_manifest(spark):
    html = (
        "<img src=logo.png><IMG SRC='../img/a%20b.png?x#y'><img src='/top.gif'><img src='../../up.png'><img src='http://h/x.png'>"
        "<img src='data:x'><img src='none.png'><img><img src='c+d.png'><img src='#top'><script><img src='no.png'></script>"
    )
    pages = spark.createDataFrame([("docs/p.html", html), ("docs/q.html", None), ("r.html", "<img src=logo.png>")], "path string, html string")
    manifest = spark.createDataFrame([(p,) for p in ("docs/logo.png", "img/a b.png", "top.gif", "docs/c+d.png", "up.png", "docs/logo.png")], "path string")
    rows = sorted(structure.page_images(pages, manifest).collect())
    assert [(r.pos, r.is_local, r.target, r.found) for r in rows if r.path == "docs/p.html"] == [
        (0, True, "docs/logo.png", True), (1, True, "img/a b.png", True), (2, True, "top.gif", True), (3, True, None, False), (4, False, None, False),
        (5, False, None, False), (6, True, "docs/none.png", False), (7, True, "docs/c+d.png", True), (8, True, None, False),
    ]
    assert [(r.target, r.found) for r in rows if r.path == "r.html"] == [("logo.png", False)]

"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as cell
from ..functions import commits as commit
from ..functions import html as page
from ..functions import paths, ranges, repo_url, routes, text
from ..functions.cells import float_text
from ..operators import assembly, enrichment, html_structure, ignore, jobs, listing, numbering, rule_table as rule_tables, segments, selection, stats, versions
from ..session import shared_folder, stage
from ..sinks import json_export, text_export
from ..sources import decode, rules
from ..streaming import current, ingest, status, uploads as upload_stream
from .convert import Elements, convert
from .corpus_view import corpus, document_path, load
from .export_many import decided_repositories

#: The limit of the queries that show the size rule.
MAX_KB = 2
EXCLUDED = "docs/*/*.md;*[5-7].csv"
INCLUDED = "*.md;src/*/doc*[0-4].txt;docs/**/*.py;source?/*;/docs/*/*.csv;/fr/*.txt"
RULE_LINES = ["# local rules", "", "docs/*", "*3.json", "src*/fr/*", "!venv/en/*", "!*7.md"]
RULES = rules.Rules.of(RULE_LINES)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under its function name."""
    QUERIES[build.__name__] = build
    return build


def _content() -> Column:
    return F.col("text").cast("binary")


def _selected(spark: SparkSession, sf_dir: str, max_kb: int | None = None) -> DataFrame:
    return selection.select_files(corpus(spark, sf_dir), max_kb, "exclude", EXCLUDED)


def _decided(spark: SparkSession, sf_dir: str, max_kb: int | None = None) -> DataFrame:
    return ignore.decide(
        _selected(spark, sf_dir, max_kb), RULES, selection.file_kind(F.col("path"), _content())
    )


# --- selection -----------------------------------------------------------------------


@query
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.export_stats(_decided(spark, sf_dir, MAX_KB), ["source"]).orderBy("source")


@query
def file_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = selection.file_kind(F.col("path"), _content())
    return _selected(spark, sf_dir, MAX_KB).select("doc_id", "path", "length", kind.alias("kind"))


@query
def glob_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir)
    return files.where(selection.glob_choice(F.col("path"), "include", INCLUDED)).select("doc_id", "path")


@query
def glob_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir)
    return files.where(selection.glob_choice(F.col("path"), "exclude", INCLUDED)).select("doc_id", "path")


@query
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir)
    kind = selection.file_kind(F.col("path"), _content())
    return ignore.decide(files, RULES, kind).select("doc_id", "path", "decision")


@query
def kept_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ignore.keep(corpus(spark, sf_dir), RULES).select("doc_id", "path")


@query
def dropped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ignore.drop(corpus(spark, sf_dir), RULES).select("doc_id", "path")


def _named_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents filed under the name of a part."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    documents = load(spark, sf_dir, "documents").select("doc_id", document_path().alias("path"))
    named = documents.join(parts, F.pmod("doc_id", F.lit(200)) + 1 == F.col("p_partkey"))
    folder, file = F.substring_index("path", "/", 2), F.substring_index("path", "/", -1)
    return named.select("doc_id", F.concat_ws("/", folder, "p_name", file).alias("path"))


def _part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven patterns for each part, every seventh part's being overrides."""
    key, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    patterns = F.array(
        F.concat(F.lit("*/"), "p_name", F.lit("/doc"), text, F.lit(".*")),
        F.concat(F.lit("src"), (key % 20).cast("string"), F.lit("/*/"), "p_name", F.lit("/*[0-4].txt")),
        F.concat(F.lit("*"), "p_name", F.lit("*"), text, F.lit(".md")),
        F.concat(F.lit("*/doc?"), text, F.lit(".json")),
        F.concat(F.lit("docs/*"), F.lower("p_type"), F.lit("*")),
        F.concat(F.lit("?[!s]*"), text),
        F.concat(F.lit("*"), "p_name", F.lit("/doc"), text, F.lit("*[02468].py")),
    )
    kind = F.when(key % 7 == 0, "override").otherwise("ignore")
    return load(spark, sf_dir, "part").select(kind.alias("kind"), F.explode(patterns).alias("pattern"))


@query
def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every pattern of a long table that it matches."""
    files, rules = _named_paths(spark, sf_dir), rule_tables.index_rules(_part_rules(spark, sf_dir))
    return rule_tables.rule_matches(files, rules)


@query
def rule_table_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _named_paths(spark, sf_dir)
    return rule_tables.decide_by_table(files, _part_rules(spark, sf_dir), selection.kind_by_name(F.col("path"))).select("doc_id", "path", "decision")


@query
def rule_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule lines out of documents: every fifth line of a document negated."""
    lines = load(spark, sf_dir, "documents").select(F.posexplode(F.split("text", "\n")).alias("at", "value"))
    marked = F.when(F.col("at") % 5 == 4, F.concat(F.lit("!"), "value")).otherwise(F.col("value"))
    return rules.parse_rules(lines.select(marked.alias("value")))


@query
def type_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = selection.lookup_types(corpus(spark, sf_dir))
    return files.select("doc_id", "ext", "ext_kind", "mime", "mime_kind")


def _with_nul(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(
        F.col("doc_id") % 7 == 0, F.concat(F.substring("text", 1, 900), F.lit("\x00"), "text")
    ).otherwise(F.concat("text", F.lit("\x00")))
    return load(spark, sf_dir, "documents").select("doc_id", marked.cast("binary").alias("content"))


@query
def nul_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nul(spark, sf_dir).select("doc_id", selection.sniff_kind(F.col("content")).alias("kind"))


@query
def subdir_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.subdirectory(corpus(spark, sf_dir), "docs/", "src").select("doc_id", "path")


@query
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("url")
    return load(spark, sf_dir, "pages").select(
        "page_id",
        paths.name(path).alias("name"),
        paths.suffix(path).alias("suffix"),
        paths.stem(path).alias("stem"),
        paths.base_name(path).alias("base"),
        paths.parent(path).alias("parent"),
        paths.depth(path).alias("depth"),
    )


# --- text ----------------------------------------------------------------------------


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("doc_id") % 3
    raw = (
        F.when(third == 0, F.concat(_content(), F.lit(bytearray(b"\xff\r"))))
        .when(third == 1, F.replace("text", F.lit("\n"), F.lit("\r\n")).cast("binary"))
        .otherwise(_content())
    )
    return load(spark, sf_dir, "documents").select("doc_id", "text").select("doc_id", raw.alias("content"))


@query
def decode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("content")
    lenient = decode.lenient_text(content)
    return _bytes(spark, sf_dir).select(
        "doc_id",
        decode.used_encoding(content).alias("encoding"),
        text.char_count(decode.strict_text(content)).alias("strict_chars"),
        text.char_count(lenient).alias("lenient_chars"),
        text.line_count(lenient).alias("lenient_lines"),
        F.md5(decode.strict_text(content).cast("binary")).alias("strict_md5"),
    )


@query
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stats.measure(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return measured.select(
        "doc_id",
        "chars",
        "lines",
        "tokens",
        text.char_count(text.strip(F.col("text"))).alias("stripped_chars"),
        text.size_kb(F.octet_length("text")).alias("size_kb"),
        text.thousands(F.col("chars")).alias("chars_shown"),
    )


#: Bytes of a range; prime, so that cuts fall everywhere.
RANGE_BYTES = 251


@query
def segment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as byte ranges that cut characters, line breaks and words."""
    ranges = segments.cut_bytes(_bytes(spark, sf_dir), RANGE_BYTES)
    return segments.segment_metrics(ranges, ["doc_id"])


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages")


@query
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", page.html_text(F.col("html")).alias("text"))


@query
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _pages(spark, sf_dir)
        .select("page_id", F.posexplode(page.html_elements(F.col("html"))).alias("pos", "element"))
        .select("page_id", "pos", "element.kind", "element.text")
    )


@query
def html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", page.html_outline(F.col("html")).alias("outline"))


@query
def html_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = F.col("reference")
    folder = F.regexp_replace("url", "/[^/]*$", "")
    return (
        _pages(spark, sf_dir)
        .select(
            "page_id",
            folder.alias("folder"),
            F.posexplode(page.html_references(F.col("html"), "a", "href")).alias("pos", "reference"),
        )
        .select(
            "page_id",
            "pos",
            "reference",
            page.is_local_reference(reference).alias("is_local"),
            page.resolve_reference(reference, F.col("folder")).alias("resolved"),
        )
    )


def _order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer: a table of the orders, in every row a nested table, and a list with a list in every item."""
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    row = F.concat(
        F.lit("<tr><td>"), key, F.lit(" &amp; "), status, F.lit('<TABLE title="a>b"><tr><th>'), F.col("o_orderpriority"), F.lit("</th>\n<td>"),
        float_text(F.col("o_totalprice")), F.lit("</table> tail<td> <b>"), status, F.lit("</b> </td></tr><tr></tr>"),
    )
    item = F.concat(F.lit("<li>item "), key, F.lit("<ol><li>"), status, F.lit("<li>&lt;x></ol> end"))
    ordered = lambda text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", text.alias("x")))), lambda e: e["x"]), "")
    pages = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(ordered(row).alias("rows"), ordered(item).alias("items"))  # one customer's orders
    html = F.concat(F.lit("<html><body></table><p>x</p><table><caption>c</caption>"), "rows", F.lit("</table><ul>"), "items", F.lit("</ul></body></html>"))
    return pages.select("o_custkey", html.alias("html"))


@query
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_structure.table_cells(_order_pages(spark, sf_dir), ["o_custkey"])


@query
def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_structure.table_rows(html_structure.table_cells(_order_pages(spark, sf_dir), ["o_custkey"]), ["o_custkey"])


@query
def html_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_structure.list_items(_order_pages(spark, sf_dir), ["o_custkey"])


@query
def html_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages that show their neighbours' files, files that are not there, and files elsewhere."""
    files = corpus(spark, sf_dir).select("doc_id", "path")
    other = files.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("other"))
    name = F.substring_index("path", "/", -1)
    image = lambda *parts: F.concat(F.lit('<p><IMG alt="x>y" src="'), *parts, F.lit('">'))
    html = F.concat(
        image(F.lit("./"), name, F.lit("?size=1#top")), image(F.lit("../../"), "other"), image(F.lit("../x/.././../"), F.replace("other", F.lit("/"), F.lit("//"))),
        image(F.lit("/"), F.replace("other", F.lit("o"), F.lit("%6F"))), image(F.lit("../../"), "other", F.lit(".png")), image(F.lit("../../../"), "other"),
        image(F.lit("https://host/"), "other"), image(F.lit("data:image/png;base64,AA==")), F.lit("<!-- <img src='no'> --><img alt=none>"),
    )
    pages = files.join(other, "doc_id").select("path", html.alias("html"))
    return html_structure.page_images(pages, files)


# --- assembly ------------------------------------------------------------------------


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = F.posexplode(F.array("role", "text")).alias("shape_no", "text")
    return load(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("slide_no"), shapes)


@query
def slide_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.slide_text(assembly.slide_lines(_shapes(spark, sf_dir), ["conv_id"]), ["conv_id"], bits=1, limit=400)


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(col_no: int, value: Column, vtype: str) -> Column:
        return F.struct(F.lit(col_no).alias("col_no"), value.cast("string").alias("value"), F.lit(vtype).alias("vtype"))

    note = F.when(F.col("o_orderstatus") == "O", " , ").when(F.col("o_orderstatus") == "F", "")
    entries = F.array(
        one(1, F.col("o_orderkey"), "int"),
        one(2, F.concat(F.lit(" "), "o_orderstatus"), "str"),
        one(3, F.col("o_totalprice"), "float"),
        one(4, F.col("o_orderdate"), "datetime"),
        one(5, note, "str"),
        one(6, F.col("o_orderkey") % 2 == 0, "bool"),
    )
    return load(spark, sf_dir, "orders").select(
        "o_custkey",
        F.col("o_orderpriority").alias("sheet"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("sheet_no"),
        F.col("o_orderkey").alias("row_no"),
        entries.alias("cells"),
    )


def _order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_rows(spark, sf_dir).withColumn("c", F.explode("cells")).drop("cells")
    return rows.select("o_custkey", "sheet", "sheet_no", "row_no", "c.*")


@query
def sheet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows that come whole."""
    lines = assembly.sheet_row_lines(_order_rows(spark, sf_dir), ["o_custkey"])
    return assembly.sheet_text(lines, ["o_custkey"])


@query
def sheet_cells_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same out of single cells."""
    lines = assembly.sheet_lines(_order_cells(spark, sf_dir), ["o_custkey"])
    return assembly.sheet_text(lines, ["o_custkey"])


@query
def sheet_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = assembly.sheet_csv_lines(_order_cells(spark, sf_dir), ["o_custkey"])
    book = F.concat(F.lit("book."), F.col("o_custkey").cast("string"), F.lit(".xlsx"))
    return lines.select(
        "o_custkey", "row_no", routes.sheet_output_name(book, F.col("sheet")).alias("file"), "text"
    )


@query
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows need no cell table."""
    described = F.when(F.col("p_size") > 25, F.concat_ws(", ", "p_name", "p_type")).otherwise(F.col("p_name"))
    blank = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    fields = F.array(F.col("p_partkey").cast("string"), described, blank, float_text(F.col("p_retailprice")))
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        cell.sheet_label(F.concat_ws(" ", "p_type", "p_brand")).alias("sheet"),
        cell.csv_line(fields).alias("line"),
        cell.pipe_row(fields).alias("row"),
    )


@query
def cell_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("c_acctbal") * F.pow(F.lit(10.0), (F.col("c_custkey") % 40 - 16).cast("double"))
    rounded = F.floor(F.col("c_acctbal")) * F.when(F.col("c_custkey") % 2 == 0, 1e3).otherwise(1e15)
    return load(spark, sf_dir, "customer").select(
        "c_custkey",
        float_text(F.col("c_acctbal")).alias("balance"),
        float_text(rounded).alias("rounded"),
        (float_text(value).cast("double") == value).alias("round_trips"),
        cell.bool_text(F.col("c_acctbal") < 0).alias("overdrawn"),
    )


def _page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.posexplode(F.split("text", "\n")).alias("at", "text")
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.select("doc_id", pages).select(
        "doc_id", (F.col("at") + 1).cast("bigint").alias("page_no"), "text"
    )


@query
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = assembly.page_lines(_page_texts(spark, sf_dir), ["doc_id"])
    return assembly.page_text(lines, ["doc_id"], bits=4, limit=600)


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("bigint")
    paragraphs = load(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text")
    )
    cells = load(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 10).cast("bigint").alias("doc_id"),
        (F.col("p_partkey") % 2 + 1).alias("table_no"),
        (F.col("p_partkey") % 10).alias("row_no"),
        F.posexplode(F.array("p_name", F.lit(" "), "p_brand", F.col("p_size").cast("string"))).alias("col_no", "text"),
    )
    return paragraphs.select(
        "doc_id",
        F.lit("paragraph").alias("kind"),
        none.alias("table_no"),
        none.alias("row_no"),
        F.lit(None).cast("int").alias("col_no"),
        F.col("seq").cast("bigint").alias("seq"),
        "text",
    ).unionByName(
        cells.select(
            "doc_id", F.lit("cell").alias("kind"), "table_no", "row_no", "col_no", none.alias("seq"), "text"
        )
    )


@query
def word_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = assembly.word_lines(_elements(spark, sf_dir), ["doc_id"])
    return assembly.word_text(lines, ["doc_id"], bits=3)


@query
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = assembly.sheet_lines(_order_cells(spark, sf_dir), ["o_custkey"]).where(F.col("row_no") >= 0)
    return stats.count_rows(lines, ["o_custkey", "sheet_no"])


def _page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = ["1-3", "5-2", "2", "3,1,3", "", "x-1", " 4 - 6 , 2", "900-1000", "1-99999999"]
    spec = F.get(F.array(*[F.lit(s) for s in specs]), (F.col("doc_id") % len(specs)).cast("int"))
    return load(spark, sf_dir, "documents").select(
        "doc_id", spec.alias("spec"), text.line_count(F.col("text")).alias("n_pages")
    )


@query
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, n_pages = F.col("spec"), F.col("n_pages")
    return _page_requests(spark, sf_dir).select(
        "doc_id",
        "spec",
        ranges.range_text(ranges.parse_page_range(spec)).alias("parsed"),
        ranges.range_text(ranges.pages_in_bounds(spec, n_pages)).alias("pages"),
        ranges.page_error(spec, n_pages).alias("error"),
    )


@query
def selected_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _page_requests(spark, sf_dir).select(
        "doc_id", ranges.pages_in_bounds(F.col("spec"), F.col("n_pages")).alias("pages")
    )
    chosen = assembly.selected_pages(_page_texts(spark, sf_dir), requests, ["doc_id"])
    lines = assembly.page_lines(chosen, ["doc_id"], headed=True)
    return assembly.page_text(lines, ["doc_id"], bits=2)


# --- enrichment, listing, export -----------------------------------------------------


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("path"),
        F.concat(F.lit("\n "), "event_type", F.lit(" "), "props", F.lit("\n")).alias("message"),
        F.concat(F.lit("author"), (F.col("event_id") % 7).cast("string")).alias("author"),
        F.col("ts").alias("committed_at"),
        F.col("event_id").cast("string").alias("sha"),
    )


@query
def last_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "customer").select(
        F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("path")
    )
    enriched = enrichment.with_last_commit(files, _commits(spark, sf_dir))
    found = enriched.select("path", "last_commit.*")
    line = commit.commit_line(F.col("message"), F.col("author"), F.col("date"))
    return found.withColumn("line", F.coalesce(line, F.lit("Last Commit: No commits found")))


@query
def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    customer = load(spark, sf_dir, "customer")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    files = joined.select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"))
    return listing.directory_tree(files)


@query
def corpus_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _decided(spark, sf_dir).where(F.col("decision").isin("kept", "override"))
    return listing.directory_tree(kept)


@query
def sorted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.sort_by_path(corpus(spark, sf_dir).select("path", "length"))


@query
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision is staged once; header, tree, files and summary read what they need of it."""
    return text_export.text_export(stage(_decided(spark, sf_dir)), "documents")


def _document_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as commits to documents: the events go round all documents."""
    documents = load(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("n")).scalar()
    return _commits(spark, sf_dir).withColumn("doc_id", F.col("sha").cast("bigint") % documents).drop("path")


@query
def export_text_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = enrichment.with_last_commit(_decided(spark, sf_dir), _document_commits(spark, sf_dir), "doc_id")
    return text_export.text_export(stage(decided), "documents", with_commits=True)


@query
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = enrichment.with_last_commit(_decided(spark, sf_dir), _document_commits(spark, sf_dir), "doc_id")
    entries = json_export.json_entries(decided, "documents")
    return entries.select("repository", "path", "content", "last_commit.*")


@query
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested document as its ordered lines."""
    return json_export.json_document(json_export.json_entries(stage(_decided(spark, sf_dir)), "documents"), "documents")


@query
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = stats.export_stats(_decided(spark, sf_dir))
    return totals.select("*", text_export.summary_block().alias("block"))


def _repository_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule file for each source but every fifth one; a source's number makes its rules its own."""
    name = F.col("source")
    number = F.regexp_extract(name, "([0-9]+)$", 1).try_cast("int")
    digit = (number % 10).cast("string")
    lines = F.array(
        F.concat(F.lit("# rules of "), name), F.lit("  "), F.concat(F.lit("*"), digit, F.lit(".txt")), F.concat(F.lit("src/*/doc*"), digit, F.lit("?.py")),
        F.concat(F.lit("docs/"), F.when(number % 2 == 0, "en").otherwise("fr"), F.lit("/*")), F.lit(" *.csv "),
        F.concat(F.lit("!*"), digit, F.lit(".pyc")), F.concat(F.lit("!venv/*[!"), digit, F.lit("].csv")), F.concat(F.lit("!"), name, F.lit("/en/*")),
    )
    sources = load(spark, sf_dir, "documents").select("source").distinct().where(F.coalesce(number % 5 != 4, F.lit(True)))
    return sources.select(name.alias("repository"), F.explode(lines).alias("value"))


def _repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir).withColumnRenamed("source", "repository").withColumn("content", _content()).drop("text")
    return stage(decided_repositories(files, _repository_rules(spark, sf_dir)))


@query
def export_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidated document of every source, each with rules of its own."""
    return text_export.text_exports(_repositories(spark, sf_dir))


@query
def export_many_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = json_export.json_entries(_repositories(spark, sf_dir), F.col("repository"))
    return entries.select("repository", "path", "content")


def _numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of outputs: plain, numbered and with another bracket."""
    third = F.col("p_partkey") % 3
    number = (
        F.when(third == 0, F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")")))
        .when(third == 1, "(copy)")
        .otherwise("")
    )
    return load(spark, sf_dir, "part").select(F.concat(F.lit("out/"), "p_name", number, F.lit(".text")).alias("path"))


@query
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = load(spark, sf_dir, "part").select(
        F.concat(
            F.lit("out/"), "p_name", F.when(F.col("p_size") > 45, F.concat(F.lit(" "), "p_type")).otherwise(""), F.lit(".text")
        ).alias("path")
    ).distinct()
    return versions.next_versions(wanted, _numbered_names(spark, sf_dir))


@query
def next_version_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each order, most families wanted many times; a third of the names is of one family."""
    customer = F.col("o_custkey")
    name = F.when(F.col("o_orderkey") % 3 == 0, "hot gear").otherwise(F.concat(F.lit("part "), (customer % 500).cast("string")))
    number = F.when(customer % 2 == 0, F.concat(F.lit("("), (customer % 50).cast("string"), F.lit(")"))).otherwise("")
    orders = load(spark, sf_dir, "orders")
    wanted = orders.select("o_orderkey", F.concat(F.lit("out/"), name, number, F.lit(".text")).alias("path"))
    existing = _numbered_names(spark, sf_dir).where(~F.col("path").contains("copy"))
    return versions.next_versions(wanted, existing, order=["o_orderkey"])


# --- jobs ----------------------------------------------------------------------------


def _as_uploads(files: DataFrame) -> DataFrame:
    """Documents (``doc_id``, ``source``, ``path``, ``length``) as uploads of their source."""
    name = paths.name(F.col("path"))
    extension = paths.suffix(F.col("path"))
    content_type = (
        F.when(extension.isin(".txt", ".csv", ""), "text/plain")
        .when(extension == ".pdf", "application/pdf")
        .when(extension == ".md", "text/html")
        .otherwise("application/octet-stream")
    )
    renamed = F.when(extension == ".md", F.concat(name, F.lit(".html"))).otherwise(name)
    return files.select(
        F.col("source").alias("job_id"),
        F.col("doc_id").alias("pos"),
        renamed.alias("filename"),
        content_type.alias("content_type"),
        (F.col("length") * 5000).alias("length"),
    )


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_uploads(corpus(spark, sf_dir))


@query
def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.validate_uploads(_uploads(spark, sf_dir))


@query
def upload_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.request_verdicts(jobs.validate_uploads(_uploads(spark, sf_dir)))


@query
def convertible_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.convertible(_uploads(spark, sf_dir), 10_000, "exclude", "doc*1.txt").select("job_id", "filename")


def _route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [".doc", ".docx", ".xls", ".xlsx", ".ppt", ".PPTX", ".mhtml", ".mht", ".html", ".htm", ".py", ".pdf", ".zip", ""]
    extension = F.get(F.array(*[F.lit(e) for e in known]), (F.col("doc_id") % len(known)).cast("int"))
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat("source", F.lit("/report.v"), F.col("doc_id").cast("string"), extension).alias("path"),
        F.explode(F.array(*[F.lit(f) for f in [*routes.FORMATS, "docx"]])).alias("format"),
    )


@query
def conversion_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, output_format = F.col("path"), F.col("format")
    return _route_requests(spark, sf_dir).select(
        "doc_id",
        "format",
        routes.conversion_route(paths.suffix(path), output_format).alias("outcome"),
        routes.output_name(path, output_format).alias("output"),
        routes.upload_output_name(path, output_format).alias("upload_output"),
    )


@query
def route_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _route_requests(spark, sf_dir).withColumn("ext", paths.suffix(F.col("path")))
    return jobs.lookup_routes(requests).select("doc_id", "format", "outcome")


@query
def mhtml_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    half, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    body = F.concat(
        "text",
        F.when(half, "\nMIME-Version: 1.0").otherwise(""),
        F.when(third, "\nContent-Type: multipart/related").otherwise(""),
    )
    return load(spark, sf_dir, "documents").select("doc_id", routes.mhtml_refusal(body).alias("reason"))


def _file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = numbering.number_rows(load(spark, sf_dir, "events"), ["user_id"], "event_id")
    return numbered.select(
        F.col("user_id").cast("string").alias("job_id"),
        F.col("pos").cast("bigint").alias("pos"),
        F.concat(F.lit("file"), F.col("event_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("bad "), "props")).alias("error"),
        F.col("ts"),
    )


@query
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values far apart: an event's number in billionths."""
    sparse = (F.col("event_id") * 1_000_000_007).alias("event_id")
    return numbering.number_rows(load(spark, sf_dir, "events").select("user_id", sparse), ["user_id"], "event_id")


@query
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    known = load(spark, sf_dir, "customer").select(
        key.cast("string").alias("job_id"),
        F.when(key % 11 == 5, "shred").otherwise("convert").alias("command"),
        F.when(key % 7 == 3, "gif").otherwise("text").alias("format"),
    )
    return jobs.job_status(known, _file_results(spark, sf_dir))


@query
def job_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_errors(_file_results(spark, sf_dir))


@query
def error_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.error_details(_file_results(spark, sf_dir))


@query
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("doc_id") % 4 == 1, ".csv").otherwise(".text")
    outputs = corpus(spark, sf_dir).select(
        F.col("source").alias("job_id"),
        F.col("doc_id").alias("pos"),
        F.concat(paths.base_name(F.col("path")), ending).alias("output"),
        "text",
    )
    return jobs.first_previews(outputs)


# --- whole conversions ---------------------------------------------------------------


def _named(frame: DataFrame, prefix: str, key: str, extension: str) -> DataFrame:
    """Add ``path`` made of a prefix, the key and an extension."""
    return frame.withColumn("path", F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(extension)))


def _document_file() -> Column:
    """File name of a document: a text, a paged document, an MHTML file or an archive."""
    turn = F.col("doc_id") % 4
    extension = F.when(turn == 0, ".txt").when(turn == 1, ".PDF").when(turn == 2, ".mht").otherwise(".zip")
    return F.concat(F.lit("d"), F.col("doc_id").cast("string"), extension)


def _mixed_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Elements]:
    """Texts, web pages, slide decks, workbooks and paged documents in one table."""
    documents = load(spark, sf_dir, "documents").select(_document_file().alias("path"), _content().alias("content"))
    pages = _named(load(spark, sf_dir, "pages"), "p", "page_id", ".html")
    shapes = _named(_shapes(spark, sf_dir), "c", "conv_id", ".pptx")
    cells = _named(_order_cells(spark, sf_dir), "o", "o_custkey", ".xlsx")
    nothing = F.lit(None).cast("binary").alias("content")
    decks = _named(load(spark, sf_dir, "conversations"), "c", "conv_id", ".pptx").select("path").distinct()
    books = _named(load(spark, sf_dir, "customer"), "o", "c_custkey", ".xlsx").select("path")
    files = (
        documents.unionByName(pages.select("path", F.col("html").cast("binary").alias("content")))
        .unionByName(decks.select("path", nothing))
        .unionByName(books.select("path", nothing))
    )
    paged = _page_texts(spark, sf_dir).withColumn("path", _document_file())
    paged = paged.where(paths.suffix(F.col("path")).isin(routes.PDF))
    return files, Elements(cells=cells, shapes=shapes, page_texts=paged)


@query
def convert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, parts = _mixed_files(spark, sf_dir)
    return convert(files, "text", parts)


@query
def convert_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, parts = _mixed_files(spark, sf_dir)
    return convert(files, "csv", parts)


@query
def convert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page selection that some documents and decks cannot meet."""
    files, parts = _mixed_files(spark, sf_dir)
    return convert(files, "text", parts, pages="4-5, 9, 7-8").where(
        paths.suffix(F.col("path")).isin(*routes.PDF, *routes.SLIDES)
    )


# --- scalar odds and ends ------------------------------------------------------------


@query
def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id") % 6
    path = F.regexp_replace("url", "^https?://([^/]+)/", "$1/")
    rest = F.regexp_replace(path, r"[?#].*$", "")
    made = (
        F.when(key == 0, F.concat(F.lit("https://github.com/"), rest))
        .when(key == 1, F.concat(F.lit("http://github.com/owner/repo"), F.col("page_id").cast("string"), F.lit(".git")))
        .when(key == 2, F.concat(F.lit("https://github.com/owner/repo/tree/dev/"), rest))
        .when(key == 3, F.concat(F.lit("https://github.com/owner/repo/issues/"), rest))
        .when(key == 4, F.col("url"))
        .otherwise(F.lit("https://github.com/owner/repo/tree/main/"))
    )
    urls = load(spark, sf_dir, "pages").select("page_id", made.alias("url"))
    plain, deep = repo_url.parse_repo_url(F.col("url")), repo_url.parse_repo_url(F.col("url"), True)
    return urls.select(
        "page_id",
        repo_url.is_repo_url(F.col("url")).alias("valid"),
        plain["base"].alias("base"),
        plain["branch"].alias("branch"),
        plain["subdir"].alias("no_subdir"),
        deep["subdir"].alias("subdir"),
        repo_url.repo_name(plain["base"]).alias("name"),
    )


@query
def mask_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = F.left("c_name", (F.col("c_custkey") % 12).cast("int"))
    return load(spark, sf_dir, "customer").select("c_custkey", text.mask_secret(secret).alias("masked"))


# --- streams -------------------------------------------------------------------------


def _run_folder(spark: SparkSession) -> tuple[str, str]:
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    return f"{base}/out", f"{base}/state"


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a stream, decided and measured as in a batch."""
    output, checkpoint = _run_folder(spark)
    rows = ingest.landing_table(
        spark,
        f"{sf_dir}/documents.parquet",
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    files = rows.select(
        document_path().alias("path"), F.octet_length("text").cast("bigint").alias("length"), _content().alias("content")
    )
    measured = ingest.measured_files(files, rules=RULES).drop("text")
    ingest.append_batches(measured, output, checkpoint).awaitTermination()
    return spark.read.parquet(output).select("path", "length", "decision", "chars", "lines", "tokens")


@query
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file results arriving; positions are event numbers."""
    output, checkpoint = _run_folder(spark)
    rows = ingest.landing_table(
        spark,
        f"{sf_dir}/events.parquet",
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    )
    results = rows.select(
        F.col("user_id").cast("string").alias("job_id"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )
    status.track_jobs(results, output, checkpoint).awaitTermination()
    return status.latest_status(spark, output)


@query
def stream_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file results of jobs that end when nothing comes for two days, or with their last file."""
    output, checkpoint = _run_folder(spark)
    rows = ingest.landing_table(
        spark,
        f"{sf_dir}/events.parquet",
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    )
    results = rows.select(
        F.col("user_id").cast("string").alias("job_id"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    totals = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("job_id"), (F.col("c_custkey") % 200).alias("n_total"))
    current.follow_jobs(results, output, checkpoint, "2 days", totals).awaitTermination()
    columns = ["job_id", "n_files", "n_errors", "last_ok", "status"]
    return current.current_jobs(spark, output).select(*columns).unionByName(current.finished_jobs(spark, output).select(*columns))


@query
def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uploads of every source as a stream, and a request that announces their number but for every third source, whose are late."""
    output, checkpoint = _run_folder(spark)
    rows = ingest.landing_table(
        spark,
        f"{sf_dir}/documents.parquet",
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    arriving = _as_uploads(rows.select("doc_id", "source", document_path().alias("path"), F.octet_length("text").cast("bigint").alias("length")))
    arriving = arriving.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    counts = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("job_id")).agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.crc32(F.encode("job_id", "UTF-8")) % 3 == 0, 1).otherwise(0)
    folder = f"{output}-requests"
    counts.select("job_id", (F.col("n") + more).alias("n_files"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts")).write.parquet(folder)
    announced = spark.readStream.schema("job_id string, n_files bigint, ts timestamp").parquet(folder)
    upload_stream.follow_requests(announced, arriving, output, checkpoint).awaitTermination()
    waiting = upload_stream.open_requests(spark, output).select("job_id", "n_files", "n_rejected", F.lit(None).cast("string").alias("error"), F.lit(False).alias("complete"))
    return upload_stream.verdicts(spark, output).unionByName(waiting)

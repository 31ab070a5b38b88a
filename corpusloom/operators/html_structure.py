"""Tables, lists and images of web pages as rows, however deeply tables and lists are nested.

Markup is cut at the tags that matter, a row for each tag with the text that follows it. The depth of a tag is a running sum over
opening and closing tags, and the table (or list) that a text belongs to is the last one opened at its depth. So the text behind a nested
table belongs to the cell around it, and a nested table's rows are its own. Rows, cells and items left open end where the next one of
their table begins. Windows are over the tags of one page; pages are dealt to tasks by their bytes, as a task sorts the tags of its pages
several times and Spark would size it by their compressed bytes, which for markup are a small share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import PIPE
from ..functions.html import decode_references, html_references, is_local_reference, local_target, tag_pieces
from ..functions.paths import parent
from ..functions.text import strip
from ..session import stage, task_count

#: Bytes of pages whose tags one task sorts; in memory that is some twelve times as much.
TASK_BYTES = 16 << 20

_PAGE, _AT = "_page", "_at"


def _tags(pages: DataFrame, keys: list[str], html: str, containers: str, parts: str) -> tuple[DataFrame, int]:
    """``keys``, the page, place, ``tag`` (closing ones with ``/``), ``text`` up to the next tag, ``owner`` (the container's place) and ``depth``;
    and over how many tasks the pages are dealt."""
    numbered = pages.select(*keys, html).where(F.col(html).rlike(f"(?i)<(?:{containers})")).withColumn(_PAGE, F.monotonically_increasing_id())
    numbered = stage(numbered)  # once, as the tags are read twice
    size = numbered.agg(F.sum(F.octet_length(html))).first()[0]
    tasks = task_count(pages.sparkSession, size, TASK_BYTES)
    cut = numbered.repartition(tasks, _PAGE).select(*keys, _PAGE, F.posexplode(tag_pieces(F.col(html), f"{containers}|{parts}")).alias(_AT, "piece"))
    tags = cut.select(*keys, _PAGE, _AT, F.col("piece.tag").alias("tag"), F.col("piece.text").alias("text"))
    by_page = Window.partitionBy(_PAGE).orderBy(_AT)
    opens, closes = F.col("tag").rlike(f"^(?:{containers})$"), F.col("tag").rlike(f"^/(?:{containers})$")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    # a closing tag without its opening one closes nothing: depth counts from the lowest point so far
    tags = tags.withColumn("_sum", F.sum(step).over(by_page))
    tags = tags.withColumn("depth", F.col("_sum") - F.least(F.min("_sum").over(by_page.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    owner = F.max(F.when(opens, F.col(_AT))).over(Window.partitionBy(_PAGE, "depth").orderBy(_AT))
    tags = tags.withColumn("owner", F.when(F.col("depth") > 0, owner))
    return tags.withColumn("number", F.count_if(opens).over(by_page)).drop("_sum"), tasks


def _with_numbers(rows: DataFrame, tags: DataFrame, opens: Column, tasks: int) -> DataFrame:
    """The rows with what :func:`_numbers` says of their containers; both are dealt over as many tasks as the pages."""
    by = [_PAGE, "owner"]
    return rows.repartition(tasks, *by).join(_numbers(tags, opens).repartition(tasks, *by), by)


def _numbers(tags: DataFrame, opens: Column) -> DataFrame:
    """``number`` (in order of opening), ``depth`` and the ``outer`` container of each container of a page."""
    opened = tags.where(opens).select(_PAGE, F.col(_AT).alias("owner"), "number", "depth")
    # the one around is the last one of the next lower depth before it: each stands once at its depth, and asks once one below
    asked = F.explode(F.array(F.struct(F.col("depth").alias("at_depth"), F.lit(False).alias("asks")), F.struct((F.col("depth") - 1).alias("at_depth"), F.lit(True).alias("asks"))))
    both = opened.select("*", asked.alias("x")).select(_PAGE, "owner", "number", "depth", "x.*")
    before = F.last(F.when(~F.col("asks"), F.col("number")), ignorenulls=True).over(Window.partitionBy(_PAGE, "at_depth").orderBy("owner"))
    return both.withColumn("outer", F.coalesce(before, F.lit(0).cast("bigint"))).where("asks").select(_PAGE, "owner", "number", "depth", "outer")


def table_cells(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """``(keys, table_no, outer_table, row_no, col_no, kind, text)``: every ``td`` and ``th``, in its own table.

    Tables count from 1 in order of opening, ``outer_table`` is 0 outside any. Rows without cells have no number. A cell's text leaves out the
    tables inside it, which stand on their own. A cell outside any row begins one.
    """
    tags, tasks = _tags(pages, keys, html, "table", "tr|td|th")
    tag, own = F.col("tag"), Window.partitionBy(_PAGE, "owner").orderBy(_AT)
    inside = tags.where(F.col("owner").isNotNull())
    is_cell = tag.isin("td", "th")
    # the cell that a text belongs to: the last one opened in its table, unless something ended it
    edge = F.when(is_cell, F.col(_AT)).when(tag.isin("/td", "/th", "tr", "/tr", "table"), F.lit(-1))
    inside = inside.withColumn("cell", F.last(edge, ignorenulls=True).over(own)).withColumn("line", F.count_if(tag == "tr").over(own))
    texts = inside.where(F.col("cell") >= 0)
    cells = texts.groupBy(*keys, _PAGE, "owner", "line", "cell").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(_AT, "text"))), lambda x: x["text"]), "").alias("text"),
        F.max(F.when(is_cell, tag)).alias("kind"),
    )
    row, column = Window.partitionBy(_PAGE, "owner").orderBy("line"), Window.partitionBy(_PAGE, "owner", "line").orderBy("cell")
    placed = cells.withColumns({"row_no": F.dense_rank().over(row).cast("bigint"), "col_no": F.row_number().over(column).cast("bigint")})
    return _with_numbers(placed, tags, tag == "table", tasks).select(
        *keys, F.col("number").alias("table_no"), F.col("outer").alias("outer_table"), "row_no", "col_no", "kind",
        strip(decode_references(F.col("text"))).alias("text"),
    )


def table_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, table_no, row_no, text)``: the cells of a row joined by pipes."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda x: x["text"]), PIPE)
    return cells.groupBy(*keys, "table_no", "row_no").agg(joined.alias("text"))


def list_items(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """``(keys, list_no, outer_list, depth, item_no, text)``: every ``li`` of the lists of a page, in its own list.

    An item's text leaves out the lists inside it. Lists count from 1 in order of opening; an item outside any list is in none and left out.
    """
    tags, tasks = _tags(pages, keys, html, "ul|ol", "li")
    tag, own = F.col("tag"), Window.partitionBy(_PAGE, "owner").orderBy(_AT)
    edge = F.when(tag == "li", F.col(_AT)).when(tag.isin("/li", "ul", "ol"), F.lit(-1))
    inside = tags.where(F.col("owner").isNotNull()).withColumn("item", F.last(edge, ignorenulls=True).over(own))
    items = inside.where(F.col("item") >= 0).groupBy(*keys, _PAGE, "owner", "item").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(_AT, "text"))), lambda x: x["text"]), "").alias("text")
    )
    place = F.row_number().over(Window.partitionBy(_PAGE, "owner").orderBy("item")).cast("bigint")
    return _with_numbers(items.withColumn("item_no", place), tags, tag.isin("ul", "ol"), tasks).select(
        *keys, F.col("number").alias("list_no"), F.col("outer").alias("outer_list"), "depth", "item_no", strip(decode_references(F.col("text"))).alias("text")
    )


def page_images(pages: DataFrame, manifest: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """``(path, pos, reference, is_local, target, found)``: every ``img src`` of the pages, in order.

    ``target`` is the file below the root that a local reference means, NULL if it leaves the root; ``found`` says whether the manifest has it.
    Files are looked up by one join; a picture on every page is one row of the manifest and a hot key that Spark splits.
    """
    used = pages.select(path, F.posexplode(html_references(F.col(html))).alias("pos", "reference"))
    local = is_local_reference(F.col("reference"))
    used = used.select(path, "pos", "reference", local.alias("is_local"), F.when(local, local_target(F.col("reference"), parent(F.col(path)))).alias("target"))
    files = manifest.select(F.col(path).alias("_file")).distinct().withColumn("_found", F.lit(True))
    joined = used.join(files, F.col("target") == F.col("_file"), "left")
    return joined.select(path, "pos", "reference", "is_local", "target", F.coalesce("_found", F.lit(False)).alias("found"))

"""Merkle manifest of a dataset: trees of 16 over the rows of each source, one over the sources, and a recursive climb that checks every row.

A leaf is the digest of a row's fields, each written as its UTF-8 length, a colon and the value, or ``-`` for null. The leaves of a source
stand in order of ``doc_id``; ``FAN`` neighbours make a node until one is left, the source's subroot. The subroots, ordered by source,
make the root in the same way.

* The texts are read once, into a table of leaves. Everything else works on digests of 32 bytes.
* Leaves are numbered by one range-partitioned sort over (source, id, leaf, row); counts for each task and source give the places, so a
  source that holds most rows is spread over all tasks.
* Levels are built from the leaves up and stored as node rows: a node has a parent link and the siblings before and after it. The job count
  is the height of the tree.
* A recursive query climbs from every leaf. A run is the up to ``FAN`` leaves of one parent; they share all siblings above it and climb as
  one row, each with a digest of its own: the tampered row's digest is folded with the stored siblings, which are appended to the
  proof, until the root. A climber's next node is found by a join on the node's key. Nodes above ``BLOCK_HEIGHT`` would be met by ever more
  climbers, so each is stored once for every block of ``FAN ** BLOCK_HEIGHT`` leaves below it: a key is met by 4,096 climbers at most.

``verified`` says whether the folded digest is the root, so a row whose text changed since the manifest was made is found.

Defined results: a null source is a source of its own and comes first; null ids come first within a source and are never tampered with.
Rows of one id are ordered by their leaves; equal rows are interchangeable. A source of one row has its leaf as subroot, and one source's
subroot is the root. An empty table gives no rows. Long texts are hashed whole. Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FAN_BITS = 4
FAN = 1 << FAN_BITS
#: Height of the nodes that stand for a block of the climb.
BLOCK_HEIGHT = 4
# A leaf's fields, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The heights of the tree over sources follow on this.
TOP = 100


def digest(hex_text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(hex_text, 256))


def shown(node: Column) -> Column:
    """Digests as lower-case hex text."""
    return F.lower(F.hex(node))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Digest of a row whose text is ``text``."""
    return digest(F.concat(*[field(text if name == "text" else F.col(name)) for name in fields]))


def tampered_ids(doc_id: Column) -> Column:
    """Ids whose crc32 as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def leaf_rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``leaf``, the leaf of the tampered row (null where nothing is tampered with) and a row number."""
    rows = docs.select(*FIELDS)
    forged = F.when(tampered_ids(F.col("doc_id")), leaf_digest(lower_ascii(F.col("text"))))
    return rows.select(
        "doc_id", "source", leaf_digest(F.col("text")).alias("leaf"), forged.alias("forged"), F.monotonically_increasing_id().alias("row")
    )


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add to a written table ``place``, from 0 within ``group`` by ``order`` (unique; nulls first), the group's size ``n``, and its ``key``.

    Keys ascend with the groups. One range-partitioned sort; counts for each task and group are what is summed up.
    """
    keys = [*group, *order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_task", F.shiftright("_at", 33))
    counts = ordered.groupBy("_task", *group).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)  # a row a task
    before = F.sum("_n").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(
        F.col("_task").alias("_t"), *[F.col(g).alias(f"_{g}") for g in group], (F.col("_low") - F.coalesce(before, F.lit(0))).alias("_start"),
        F.sum("_n").over(whole).alias("n"), F.min("_low").over(whole).alias("key"),
    )
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group], F.col("_task") == F.col("_t"))
    return ordered.join(counts, same).select(*rows.columns, "key", "n", (F.col("_at") - F.col("_start")).alias("place"))


def _one_left(height: int) -> Column:
    """Whether a tree of ``n`` leaves has one node at a height."""
    return F.shiftright(F.col("n") - 1, FAN_BITS * height) == 0


def levels(nodes: DataFrame, height: int, tallest: int) -> tuple[list[DataFrame], DataFrame]:
    """From nodes (``key``, ``n``, ``place``, ``node``) of a height the node rows of it and of all levels above, and what remains of each tree.

    A node row has its parent link (``up``, null under what remains) and its siblings ``before`` and ``after`` as bytes. ``tallest`` is the greatest ``n``.
    """
    rows, left = [], []
    while True:
        left.append(nodes.where(_one_left(height)).select("key", "n", "node"))
        if (tallest - 1) >> (FAN_BITS * height) <= 0:
            return rows, reduce(DataFrame.unionByName, left)
        run = F.array_sort(F.collect_list(F.struct("place", "node")))
        runs = nodes.where(~_one_left(height)).groupBy("key", "n", F.shiftright("place", FAN_BITS).alias("up")).agg(run.alias("run"))
        runs = written(runs.withColumn("node", digest(F.array_join(F.transform("run", lambda x: shown(x["node"])), ""))), "level")
        siblings = F.expr(
            "transform(run, (x, i) -> struct(x.place AS place, x.node AS node,"
            " aggregate(slice(run, 1, i), CAST('' AS BINARY), (a, y) -> concat(a, y.node)) AS before,"
            f" aggregate(slice(run, i + 2, {FAN}), CAST('' AS BINARY), (a, y) -> concat(a, y.node)) AS after))"
        )
        up = F.when(~_one_left(height + 1), F.col("up")).alias("up")
        rows.append(runs.select("key", "n", F.lit(height).alias("height"), up, F.explode(siblings).alias("x")).select("key", "n", "height", "up", "x.*"))
        nodes, height = runs.select("key", "n", F.col("up").alias("place"), "node"), height + 1


def _blocks(n: Column) -> Column:
    return F.shiftright(n - 1, FAN_BITS * BLOCK_HEIGHT) + 1


def climbing_nodes(sources: list[DataFrame], subroots: DataFrame, tops: list[DataFrame]) -> DataFrame:
    """Node rows by the keys that climbers meet: (``key`` of the source, ``block``, ``height``, ``place``), and the parent's height and place.

    A node at or above ``BLOCK_HEIGHT`` stands once for each block below it, with place 0.
    """
    more_sources = F.lit(TOP if tops else None).cast("int")
    found = []
    for height, level in enumerate(sources, 1):
        if height < BLOCK_HEIGHT:
            block, place = F.shiftright("place", FAN_BITS * (BLOCK_HEIGHT - height)), F.col("place")
        else:
            span = FAN_BITS * (height - BLOCK_HEIGHT)
            low, high = F.shiftleft("place", span), F.shiftleft(F.col("place") + 1, span)
            block, place = F.explode(F.sequence(low, F.least(high, _blocks(F.col("n"))) - 1)), F.lit(0).cast("bigint")
        up_place = F.col("up") if height + 1 < BLOCK_HEIGHT else F.lit(0).cast("bigint")
        up_height = F.when(F.col("up").isNull(), more_sources).otherwise(F.lit(height + 1))
        shape = level.select("key", block.alias("block"), "height", place.alias("place"), "before", "after", "up", F.lit(None).cast("binary").alias("subroot"))
        found.append(shape.withColumns({"up_height": up_height, "up_place": F.when(F.col("up").isNull(), 0).otherwise(up_place)}).drop("up"))
    for height, level in enumerate(tops):
        links = level.select(F.col("place").alias("_place"), "before", "after", "up", "node")
        ranked = subroots.select("source_key", "leaves", F.shiftright("place", FAN_BITS * height).alias("_above"))
        own = ranked.join(links, F.col("_above") == F.col("_place"))
        block = F.explode(F.sequence(F.lit(0).cast("bigint"), _blocks(F.col("leaves")) - 1)).alias("block")
        found.append(
            own.select(
                F.col("source_key").alias("key"), block, F.lit(TOP + height).alias("height"), F.lit(0).cast("bigint").alias("place"), "before", "after",
                F.when(F.lit(height == 0), F.col("node")).alias("subroot"), F.when(F.col("up").isNotNull(), TOP + height + 1).alias("up_height"),
                F.lit(0).cast("bigint").alias("up_place"),
            )
        )
    return reduce(DataFrame.unionByName, found)


CLIMB = """
WITH RECURSIVE climb(key, block, height, place, members, folds, path, subroot) AS (
  SELECT key, block, height, place, members, folds, path, subroot FROM {runs}
  UNION ALL
  SELECT c.key, c.block, n.up_height, n.up_place, c.members,
    transform(c.folds, f -> unhex(sha2(lower(hex(concat(n.before, f, n.after))), 256))),
    concat(c.path, n.before, n.after), coalesce(n.subroot, c.subroot)
  FROM climb c JOIN {nodes} n ON c.key = n.key AND c.block = n.block AND c.height = n.height AND c.place = n.place
)
SELECT members, folds, path, subroot FROM climb WHERE height IS NULL
"""


def _unlimited(df_of, name: str, spark) -> DataFrame:
    """Run a recursive query without its default limit of rows, into a written table."""
    setting = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "-1")
    try:
        return written(df_of(), name)
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


RESULT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def audit(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: its leaf, subroot and root, its proof's digest, and the root folded from the tampered row."""
    spark = docs.sparkSession
    leaves = placed(written(leaf_rows(docs), "leaves"), ["source"], ["doc_id", "leaf", "row"])
    member = F.struct("place", "doc_id", "leaf", F.coalesce("forged", "leaf").alias("forged"))
    runs = leaves.groupBy("key", "n", F.shiftright("place", FAN_BITS).alias("place")).agg(F.array_sort(F.collect_list(member)).alias("run"))
    own = digest(F.array_join(F.transform("run", lambda x: shown(x["leaf"])), ""))
    runs = written(runs.withColumn("node", F.when(F.col("n") == 1, F.col("run")[0]["leaf"]).otherwise(own)), "runs")
    most = runs.agg(F.max("n")).first()[0]
    if most is None:
        return spark.createDataFrame([], RESULT)
    sources, remains = levels(runs.select("key", "n", "place", "node"), 1, most)
    subroots = written(remains.select(F.col("key").alias("source_key"), F.col("n").alias("leaves"), "node"), "subroots")
    subroots = written(placed(subroots, [], ["source_key"]), "sources")
    count = subroots.count()
    tops, top = levels(subroots.select("key", "n", "place", "node"), 0, count)
    root = bytes(top.first()["node"])

    above = F.lit(TOP if tops else None).cast("int")
    others = "aggregate(run, CAST('' AS BINARY), (a, y) -> concat(a, if(y.place = x.place, x.forged, y.leaf)))"
    started = F.expr(f"transform(run, x -> if(n = 1, x.forged, unhex(sha2(lower(hex({others})), 256))))")
    start = runs.select(
        "key", F.shiftright("place", FAN_BITS * (BLOCK_HEIGHT - 1)).alias("block"), F.when(_one_left(1), above).otherwise(1).alias("height"),
        F.when(_one_left(1), 0).otherwise(F.col("place")).cast("bigint").alias("place"),
        F.transform("run", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"))).alias("members"), started.alias("folds"),
        F.lit(b"").cast("binary").alias("path"), F.lit(None).cast("binary").alias("subroot"),
    )
    if sources or tops:
        nodes = written(climbing_nodes(sources, subroots, tops), "nodes")
        climbed = _unlimited(lambda: spark.sql(CLIMB, runs=start, nodes=nodes), "climbed", spark)
    else:
        climbed = start
    each = climbed.select("members", "folds", "path", F.coalesce("subroot", F.lit(root)).alias("subroot"), F.posexplode("members").alias("at", "me"))
    siblings = F.expr("aggregate(filter(members, (x, i) -> i != at), CAST('' AS BINARY), (a, y) -> concat(a, y.leaf))")
    folded = F.get("folds", F.col("at"))
    return each.select(
        F.col("me.doc_id").alias("doc_id"), shown(F.col("me.leaf")).alias("leaf"), shown(F.col("subroot")).alias("subroot"),
        shown(F.lit(root)).alias("root"), F.sha2(shown(F.concat(siblings, "path")), 256).alias("proof_sha256"), shown(folded).alias("folded_root"),
        (folded == F.lit(root)).alias("verified"),
    )

"""Trees as stored nested sets: each node has the interval of the document-order numbers of itself and all below it.

The index is built once, with a join for each doubling of the depth: ancestors by pointers, sizes of subtrees by counting
ancestors, numbers by one sort. It is stored in document order, so a subtree, a page, what comes next and
a test for an ancestor are filters on the number, which Parquet's statistics prune.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators import pointers, ranking
from folio.sources.stored import stored

COLUMNS = ["id", "parent", "place", "depth", "ancestors", "path", "root", "first", "last", "number", "level_number"]


def built(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent, place) that hang on a root, as an index: depth, ancestors, path, root, first, last, number and level_number.

    first to last: numbers, over all roots, of a node and what is below it. number: among its root's nodes of its
    depth, in document order; level_number: among all its root's nodes, level by level. Siblings of one place are ordered by id.
    """
    tree = stored(pointers.lineage(nodes), "tree-lineage")
    below = tree.select(F.explode("ancestors").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("below"))
    tree = ranking.numbered(tree.join(below, "id", "left"), [], ["root", "keys"], "first")
    tree = tree.withColumn("last", F.col("first") + F.coalesce("below", F.lit(0))).drop("below", "keys")
    tree = ranking.numbered(tree, ["root", "depth"], ["first"])
    tree = ranking.numbered(tree, ["root"], ["depth", "place", "id"], "level_number")
    return tree.select(*COLUMNS).repartitionByRange("first").sortWithinPartitions("first")


def found(index: DataFrame, node: str):
    """The node's row, or None; one row reaches the driver."""
    return index.filter(F.col("id") == node).select("id", "depth", "root", "first", "last").first()


def between(index: DataFrame, first: int, last: int) -> DataFrame:
    return index.filter(F.col("first").between(first, last))


def subtree(index: DataFrame, node: str) -> DataFrame:
    """The node and all below it."""
    top = found(index, node)
    return between(index, top.first, top.last) if top else index.filter("false")


def next_after(index: DataFrame, node: str) -> DataFrame:
    """The first node in document order after the node and all below it, within its root."""
    top = found(index, node)
    return between(index, top.last + 1, top.last + 1).filter(F.col("root") == top.root) if top else index.filter("false")


def below(index: DataFrame, node: str, other: str) -> bool:
    """Whether other is node or below it."""
    a, b = found(index, node), found(index, other)
    return bool(a and b) and a.first <= b.first <= a.last


def page(index: DataFrame, depth: int, first: int, last: int, root: str | None = None) -> DataFrame:
    """Nodes of a depth with the numbers first to last within their root (columns head and number), and all below them.

    Of one root the page is an interval; of all roots the heads, last - first + 1 for each root at most, are joined by their id.
    """
    heads = index.filter((F.col("depth") == depth) & F.col("number").between(first, last))
    if root is not None:
        heads = heads.filter(F.col("root") == root)
        ends = heads.agg(F.min("first").alias("first"), F.max("last").alias("last")).first()
        index = between(index, ends.first, ends.last) if ends.first is not None else index.filter("false")
    head = F.when(F.col("depth") == depth, F.col("id")).otherwise(F.get("ancestors", F.lit(depth)))
    return index.drop("number").withColumn("head", head).join(heads.select(F.col("id").alias("head"), "number"), "head")


def around(index: DataFrame, depth: int, number: int, half: int) -> DataFrame:
    """root, head, number and total of the nodes of a depth at most half away from number, with the cursors before and after them (null at an end)."""
    first, last = number - half, number + half
    totals = index.filter(F.col("depth") == depth).groupBy("root").agg(F.max("number").alias("total"))
    heads = index.filter((F.col("depth") == depth) & F.col("number").between(first, last))
    before = F.lit(first - 1 if first > 1 else None).cast("int")
    after = F.when(F.col("total") > last, F.lit(last + 1))
    return heads.select("root", F.col("id").alias("head"), "number").join(totals, "root").select("root", "head", "number", "total", before.alias("before"), after.alias("after"))


def pruned(index: DataFrame, level: Column, levels: list[str], level_of) -> DataFrame:
    """Nodes of listed levels reached through nodes of listed levels alone; level_of gives an ancestor's level."""
    return index.filter(level.isin(levels) & F.forall("ancestors", lambda a: level_of(a).isin(levels)))

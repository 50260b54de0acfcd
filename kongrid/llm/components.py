"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kongrid.llm.common import attach_left
from kongrid.operators.cut import cut
from kongrid.operators.keys import BROADCAST_ROWS


def _relabel(rows: DataFrame, column: str, parents: DataFrame, few: bool) -> DataFrame:
    """Replace `column` by its node's parent where it has one; `few`: the parents are counted and may be broadcast."""
    p = parents.select(F.col("node").alias(column), F.col("parent").alias("_p"), F.col("n").alias("_n"))
    joined = rows.join(F.broadcast(p), [column], "left") if few else attach_left(rows, p, [column], "_n")
    return joined.withColumn(column, F.coalesce("_p", column)).drop("_p", "_n")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of `links` (columns a, b); root is the same for all nodes of a component.

    Each round every node takes its smallest neighbour (or itself), the chains that this makes are shortened, and links
    between the resulting roots go on. A hub costs one group of a partial aggregate, and its label is joined by `attach_left`,
    so it never fills a task. Loops and repeated links are ignored; an empty table gives no rows.
    """
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node"))
    while links.limit(1).count():
        both = links.union(links.select("b", "a"))
        parents = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("parent"), F.count("*").alias("n")))
        few = parents.count() <= BROADCAST_ROWS
        # A node's parent can have a smaller parent of its own.
        parents = cut(_relabel(parents.withColumnRenamed("n", "n_own"), "parent", parents, few).withColumnRenamed("n_own", "n"))
        found = cut(_relabel(found, "root", parents, few))
        links = _relabel(_relabel(links, "a", parents, few), "b", parents, few).where("a <> b")
        links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return found

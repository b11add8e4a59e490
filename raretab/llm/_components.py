"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, so no list of links of
a node is ever gathered; links and labels stay in staged tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raretab.llm._common import stage


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One step: each node passes its neighbours on to the least of them."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = both.join(least, "a")
    if small:
        moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    else:
        moved = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, tag: str = "cc") -> DataFrame:
    """links (a, b) -> (node, root): the least node reachable, for every node
    that has a link.  Steps repeat until the links no longer change."""
    links = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    mark = _mark(links)
    while True:
        links = stage(_star(_star(links, small=False), small=True), tag)
        after = _mark(links)
        if after == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = after


def merged(root: DataFrame, links: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, root) of ``components`` after more links (a, b): only components
    are linked, so links within one are not followed again."""
    for c in ("a", "b"):
        to = root.select(F.col("node").alias(c), F.col("root").alias("_root"))
        links = links.join(to, c, "left").withColumn(c, F.coalesce("_root", c)).drop("_root")
    step = components(links, tag)
    moved = step.select(F.col("node").alias("root"), F.col("root").alias("_root"))
    kept = root.join(moved, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    return stage(kept.union(step.join(root, "node", "left_anti").select("node", "root")), tag)


def _mark(links: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)),
                           F.coalesce(F.sum(F.pmod(h, F.lit(1 << 20))), F.lit(0))).first())

"""Connected components by alternating stars, for link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm._shared import spool

#: Links of a node beyond which its rows are no longer shuffled, and the most such nodes that are sent to all executors.
HOT_DEGREE, BROADCAST_ROWS = 100_000, 1_000_000


def _hung(sides: DataFrame, least: DataFrame, n_links: int) -> DataFrame:
    """``sides`` with the least neighbour of each node.

    The root of a large component has a row for each of its nodes.  Nodes of more
    than HOT_DEGREE rows are sent to the links, so that their rows stay where they are.
    """
    cold = least.select("node", "least")
    if n_links <= HOT_DEGREE:
        return sides.join(cold, "node")
    hot = spool(least.where(F.col("n") > HOT_DEGREE).select("node", "least"), "components")
    if not 0 < hot.count() <= BROADCAST_ROWS:
        return sides.join(cold, "node")
    cold = least.where(F.col("n") <= HOT_DEGREE).select("node", "least")
    return sides.join(F.broadcast(hot), "node").union(sides.join(F.broadcast(hot.select("node")), "node", "left_anti").join(cold, "node"))


def _star(links: DataFrame, larger: bool, n_links: int) -> DataFrame:
    """Hang the neighbours of each node (the larger ones, or all of a node's smaller ones) on its least neighbour."""
    if larger:
        sides = links.union(links.select("b", "a")).toDF("node", "other")
    else:
        sides = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = sides.groupBy("node").agg(F.min("other").alias("least"), F.count(F.lit(1)).alias("n"))
    least = spool(least.select("node", F.least("node", "least").alias("least"), "n"), "components")
    hung = _hung(sides, least, n_links)
    if larger:
        new = hung.where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    else:
        new = hung.select(F.col("other").alias("a"), F.col("least").alias("b")).union(least.select("node", "least"))
    return new.where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) of all nodes with a link; ``links`` has a and b.

    Each round is a few keyed aggregations and joins of the link table, written
    once; nothing is gathered.  Rounds grow with the logarithm of the longest path.
    """
    now = spool(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "components")
    mark, n_links = None, now.count()
    for _ in range(most_rounds):
        now = spool(_star(_star(now, True, 2 * n_links), False, 2 * n_links), "components")
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if got == mark:
            break
        mark, n_links = got, got[0]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, written


#: A node with more than this share of all ends is a hub; there are fewer than twice 1024 of them.
HUB_SHARE = 1 / 1024


def _joined_to_least(edges: DataFrame, key: str, least: DataFrame, total: int) -> DataFrame:
    """``edges`` with the smallest neighbour ``m`` of their node ``key``.

    Hubs, of which there are few by definition, are sent to all workers, so
    the many edges of one node are not shuffled into one task; all others meet
    by an equi-join.
    """
    hubs = F.broadcast(least.filter(F.col("n") > total * HUB_SHARE).select(key, "m"))
    rest = edges.join(hubs, key, "left_anti").join(least.select(key, "m"), key)
    return edges.join(hubs, key).unionByName(rest)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every neighbour above a node is tied to the smallest of the node and its neighbours. Here a < b in each edge."""
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _joined_to_least(edges, "a", least, total).select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node and its neighbours below are tied to the smallest of them. Here a < b in each edge."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
    ties = _joined_to_least(edges, "b", least, total).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return ties.unionByName(least.select(F.col("m").alias("a"), "b")).filter("a < b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.crc32(F.concat(F.col("a").cast("string"), F.lit("|"), F.col("b").cast("string"))))).first()
    )


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) of every node that has an edge to another; the root is the component's smallest node.

    ``edges`` has columns a and b of one orderable type. Loops and repeats are
    dropped. Each step is written to shared storage, so lineage stays short
    and a lost executor costs no more than a step. Only a count and two
    checksums per round reach the driver.
    """
    spark = edges.sparkSession
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = written(edges, "cc")
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        starred = written(_large_star(now, state[0]), "cc")
        after = written(_small_star(starred, state[0]), "cc")
        last, state = state, _state(after)
        discard(spark, now)
        discard(spark, starred)
        now = after
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("a").alias("node")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )

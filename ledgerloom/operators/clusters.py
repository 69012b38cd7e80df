"""Clusters: the enabled rules' edges, closed over all accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LinkConfig
from .accounts import accounts, public
from .components import connected_components
from .edges import rule_edges
from .ordering import dense_index


def close(edges: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """(account, root, cluster_id) of every account; accounts without edges stay alone."""
    if edges is None:
        rooted = nodes.select("account", F.col("account").alias("root"))
    else:
        found = connected_components(edges).withColumnRenamed("node", "account")
        rooted = nodes.join(found, "account", "left").select(
            "account", F.coalesce("root", "account").alias("root")
        )
    return rooted.join(dense_index(rooted, "root", "cluster_id"), "root").select("account", "root", "cluster_id")


def cluster(ledger: DataFrame, cfg: LinkConfig) -> DataFrame:
    seen = public(ledger)
    return close(rule_edges(seen, cfg), accounts(seen)).select("account", "cluster_id")


def sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))

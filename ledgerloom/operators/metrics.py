"""Scoring of a clustering against ownership labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pairs_of, ratio
from .accounts import accounts, ownership, payer_ownership
from .groups import burst_groups, window_groups


def _one(*parts: DataFrame) -> DataFrame:
    """Put one-row tables side by side."""
    keyed = [p.withColumn("_k", F.lit(1)) for p in parts]
    return reduce(lambda x, y: x.join(F.broadcast(y), "_k"), keyed).drop("_k")


def pair_counts(labelled: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: tp, predicted and actual same-owner pairs, from a contingency table."""
    owned = ownership(labelled).join(clusters, "account", "left")
    cells = owned.groupBy("operator", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    total = lambda df, out: df.agg(F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0)).alias(out))
    return _one(
        total(cells, "tp"),
        total(cells.groupBy("cluster_id").agg(F.sum("n").alias("n")), "pred_pos"),
        total(cells.groupBy("operator").agg(F.sum("n").alias("n")), "actual_pos"),
    )


def purity(grouped: DataFrame, out: str, by_group: bool = False) -> DataFrame:
    """Share of same-operator pairs among pairs of labelled distinct sources of a group.

    The first label of a source in a group, in group order, counts.
    """
    labels = (
        grouped.filter("operator is not null")
        .groupBy("group_id", "source")
        .agg(F.min_by("operator", F.struct("ts", "slot", "sig", "pos")).alias("operator"))
    )
    cells = labels.groupBy("group_id", "operator").agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy("group_id").agg(
        F.sum(pairs_of(F.col("n"))).alias("same"), pairs_of(F.sum("n")).alias("pairs")
    )
    if by_group:
        return groups
    both = groups.agg(F.sum("same").alias("same"), F.sum("pairs").alias("pairs"))
    return both.select(ratio(F.col("same"), F.col("pairs"), 1.0).alias(out))


def funding_records(labelled: DataFrame) -> DataFrame:
    """Self-paid transfers to an account that pays fees."""
    payers = labelled.select(F.col("fee_payer").alias("dest")).distinct()
    return labelled.filter("fee_payer = source and source <> dest").join(payers, "dest", "left_semi")


def funder_anonymity(labelled: DataFrame) -> DataFrame:
    """(funder, fundees, operators) of the funders of at least two fee payers with a known operator."""
    funded = funding_records(labelled).select(F.col("source").alias("funder"), F.col("dest").alias("fee_payer")).distinct()
    fundees = funded.groupBy("funder").agg(F.count(F.lit(1)).alias("fundees")).filter("fundees >= 2")
    known = (
        funded.join(payer_ownership(labelled), "fee_payer")
        .groupBy("funder")
        .agg(F.count_distinct("operator").alias("operators"))
    )
    return fundees.join(known, "funder")


def evaluate(labelled: DataFrame, clusters: DataFrame, window_secs: int) -> DataFrame:
    """The one-row report."""
    owned = ownership(labelled).join(clusters, "account", "left").filter("cluster_id is not null")
    per_operator = owned.groupBy("operator").agg(F.count_distinct("cluster_id").alias("n"))
    in_cluster = owned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    row = _one(
        accounts(labelled).agg(F.count(F.lit(1)).alias("num_accounts")),
        ownership(labelled).agg(F.count(F.lit(1)).alias("owned_accounts")),
        clusters.agg(F.count_distinct("cluster_id").alias("num_clusters")),
        pair_counts(labelled, clusters),
        per_operator.agg(F.coalesce(F.avg("n"), F.lit(1.0)).alias("fragmentation")),
        in_cluster.agg(F.max("n").alias("_largest")),
        purity(burst_groups(labelled), "burst_purity"),
        purity(window_groups(labelled, window_secs), "window_purity"),
        funding_records(labelled).agg(F.count(F.lit(1)).alias("funding_records")),
        funder_anonymity(labelled).agg(F.coalesce(F.avg("operators"), F.lit(1.0)).alias("funder_anonymity_set")),
    )
    p = ratio(F.col("tp"), F.col("pred_pos"), 0.0)
    r = ratio(F.col("tp"), F.col("actual_pos"), 0.0)
    row = row.withColumn("attribution_precision", p).withColumn("linkage_recall", r)
    f1 = F.when(
        F.col("attribution_precision") + F.col("linkage_recall") > 0,
        2 * F.col("attribution_precision") * F.col("linkage_recall")
        / (F.col("attribution_precision") + F.col("linkage_recall")),
    ).otherwise(0.0)
    return row.select(
        "num_accounts",
        "owned_accounts",
        "num_clusters",
        f1.alias("attribution_f1"),
        "attribution_precision",
        "linkage_recall",
        "fragmentation",
        ratio(F.coalesce("_largest", F.lit(0)), F.col("owned_accounts"), 0.0).alias("largest_cluster_frac"),
        "burst_purity",
        "window_purity",
        F.lit(window_secs).cast("long").alias("window_secs"),
        "funding_records",
        "funder_anonymity_set",
    )

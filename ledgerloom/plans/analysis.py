"""The analyses that users call: analyse, report, sweeps, worst case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..operators.clusters import cluster
from ..operators.cost import cost
from ..operators.metrics import evaluate
from ..storage import written

SWEEP = (0, 30, 60, 120, 300, 600)


def analyze(labelled: DataFrame, cfg: LinkConfig) -> tuple[DataFrame, DataFrame]:
    """(clusters, one-row report); the clusters are written, as the report reads them many times."""
    clusters = written(cluster(labelled, cfg), "clusters")
    return clusters, evaluate(labelled, clusters, cfg.scoring_window)


def report(labelled: DataFrame, funder_aware: bool = False) -> DataFrame:
    cfg = LinkConfig.funder_aware(120) if funder_aware else LinkConfig.windowed(120)
    return analyze(labelled, cfg)[1]


def rounded(row: DataFrame) -> DataFrame:
    """Every double to six digits."""
    return row.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes))


def window_sweep(labelled: DataFrame, windows: tuple = SWEEP) -> DataFrame:
    rows = [
        analyze(labelled, LinkConfig.windowed(w))[1].select(
            F.lit(w).cast("long").alias("window_secs"), "num_clusters", "attribution_precision", "linkage_recall", "attribution_f1"
        )
        for w in windows
    ]
    return reduce(DataFrame.unionByName, rows)


def worst_case(labelled: DataFrame) -> DataFrame:
    """The better of the exact and the windowed adversary."""
    exact = analyze(labelled, LinkConfig.exact_ts())[1].select(F.col("attribution_f1").alias("exact_f1"))
    windowed = analyze(labelled, LinkConfig.windowed(120))[1].select(F.col("attribution_f1").alias("windowed_f1"))
    return exact.join(F.broadcast(windowed)).withColumn("worst_f1", F.greatest("exact_f1", "windowed_f1"))


def seed_sweep(ledgers: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [worst_case(x).select("worst_f1") for x in ledgers])
    return rows.agg(F.avg("worst_f1").alias("mean_f1"), F.min("worst_f1").alias("min_f1"), F.max("worst_f1").alias("max_f1"))


def verdict(naive: DataFrame, hardened: DataFrame) -> DataFrame:
    """One row: whether the hardened ledger helped, and the drop of F1 in percent.

    It helped if F1 fell by more than 0.05 and stayed above 0, precision is at
    least 0.80 and no cluster holds half of the owned accounts.
    """
    rows = hardened.join(F.broadcast(naive.select(F.col("attribution_f1").alias("naive_f1"))))
    helped = (
        (F.col("attribution_f1") + 0.05 < F.col("naive_f1"))
        & (F.col("attribution_f1") > 0)
        & (F.col("attribution_precision") >= 0.80)
        & (F.col("largest_cluster_frac") < 0.5)
    )
    drop = F.when(F.col("naive_f1") > 0, (1 - F.col("attribution_f1") / F.col("naive_f1")) * 100)
    return rows.select(helped.alias("helped"), drop.alias("f1_drop_percent"))


__all__ = ["SWEEP", "analyze", "cost", "report", "rounded", "seed_sweep", "verdict", "window_sweep", "worst_case"]

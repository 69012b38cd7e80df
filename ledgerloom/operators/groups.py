"""Bursts, chained windows and per-destination episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import session_starts


def burst_groups(public: DataFrame) -> DataFrame:
    """Runs of consecutive slots with one timestamp; ``group_id`` is the run's first slot. Slots are unique."""
    island = F.col("slot") - F.row_number().over(W.partitionBy("ts").orderBy("slot"))
    return (
        public.withColumn("_island", island)
        .withColumn("group_id", F.min("slot").over(W.partitionBy("ts", "_island")))
        .drop("_island")
    )


def window_groups(public: DataFrame, window_secs: int) -> DataFrame:
    """Sessions over the whole ledger: a gap above ``window_secs`` starts a new one; named by its first ts."""
    return public.join(session_starts(public, [], window_secs), "ts")


def dest_episodes(public: DataFrame, window_secs: int) -> DataFrame:
    """The same, per destination."""
    return public.join(session_starts(public, ["dest"], window_secs), ["dest", "ts"])

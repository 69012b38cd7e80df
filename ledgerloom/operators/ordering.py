"""Global positions and sessions without a single-partition sort.

Both work on calendar days: a window per day runs in parallel, and only a
table of one row a day (its size is the time span, not the row count) is
ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400


def _day(ts: Column) -> Column:
    return F.floor(ts / DAY).cast("long")


def with_position(df: DataFrame, ts: str, then: list[str], out: str) -> DataFrame:
    """Add the 1-based position of each row in the order (ts, *then)."""
    rows = df.withColumn("_day", _day(F.col(ts)))
    before = (
        rows.groupBy("_day")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(F.sum("_n").over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .select("_day", "_before")
    )
    inside = F.row_number().over(W.partitionBy("_day").orderBy(ts, *then))
    return (
        rows.withColumn("_inside", inside)
        .join(before, "_day")
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_day", "_before", "_inside")
    )


def session_starts(times: DataFrame, keys: list[str], gap: int, out: str = "group_id") -> DataFrame:
    """Chained-gap sessions: map each distinct (keys, ts) to its session's first ts.

    A session goes on while the step to the next ts is at most ``gap``. Days of
    one key are handled apart and joined by a table of one row per key and day.
    """
    gap = max(gap, 0)
    stamped = times.select(*keys, "ts").distinct().withColumn("_day", _day(F.col("ts")))
    in_day = W.partitionBy(*keys, "_day").orderBy("ts")
    over_days = W.partitionBy(*keys).orderBy("_day")
    first_in_day = F.lag("ts").over(in_day)
    steps = stamped.withColumn("_prev", first_in_day)
    # the day's first ts, its last, and the start of the last session that begins inside it after its first ts
    days = (
        steps.groupBy(*keys, "_day")
        .agg(
            F.min("ts").alias("_first"),
            F.max("ts").alias("_last"),
            F.max(F.when(F.col("ts") - F.col("_prev") > gap, F.col("ts"))).alias("_inner"),
        )
        .withColumn("_before", F.lag("_last").over(over_days))
        .withColumn(
            "_opens", F.when(F.col("_before").isNull() | (F.col("_first") - F.col("_before") > gap), F.col("_first"))
        )
        .withColumn(
            "_carried",
            F.last(F.coalesce("_inner", "_opens"), ignorenulls=True).over(
                over_days.rowsBetween(W.unboundedPreceding, -1)
            ),
        )
        .select(*keys, "_day", F.coalesce("_opens", "_carried").alias("_carried"))
    )
    begun = F.max(F.when(F.col("ts") - F.col("_prev") > gap, F.col("ts"))).over(
        in_day.rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        steps.withColumn("_begun", begun)
        .join(days, [*keys, "_day"])
        .select(*keys, "ts", F.coalesce("_begun", "_carried").alias(out))
    )


def dense_index(df: DataFrame, col: str, out: str, prefix: int = 4) -> DataFrame:
    """Distinct values of a string column with their 0-based rank; ordered per prefix, then over prefixes."""
    values = df.select(col).distinct().withColumn("_p", F.substring(F.col(col), 1, prefix))
    before = (
        values.groupBy("_p")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .select("_p", "_before")
    )
    rank = F.row_number().over(W.partitionBy("_p").orderBy(col))
    return (
        values.withColumn("_r", rank)
        .join(before, "_p")
        .select(col, (F.col("_before") + F.col("_r") - 1).cast("long").alias(out))
    )

"""Structured Streaming ingestion of a journal, and episodes over the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ledger_json import RECORD, _engine


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.readStream.format("text").load(path)
    rows = lines.select(F.from_json("value", RECORD).alias("r")).filter("r.sig is not null").select("r.*")
    return _engine(rows.withColumn("pos", F.col("sig").cast("long")))


def ingest(spark: SparkSession, src: str, dest: str, checkpoint: str) -> StreamingQuery:
    """Journal to Parquet, exactly once: offsets and commits live in the checkpoint folder.

    Each batch owns one folder of the target, so a repeated batch replaces itself.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{dest}/batch={batch_id}")

    return (
        read_stream(spark, src)
        .writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dest_episode_stream(records: DataFrame, window_secs: int, lateness: str = "1 hour") -> DataFrame:
    """Per-destination episodes over a stream, with late records dropped after ``lateness``."""
    timed = records.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", lateness)
    return (
        timed.groupBy("dest", F.session_window("event_time", f"{window_secs} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("records"), F.sum("amount").alias("amount"))
        .select("dest", F.unix_seconds(F.col("w.start")).alias("group_id"), "records", "amount")
    )

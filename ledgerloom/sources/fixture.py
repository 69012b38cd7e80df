"""A deterministic ledger projected from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import with_position

COLUMNS = ["sig", "slot", "ts", "fee_payer", "source", "dest", "amount", "kind", "operator", "pos"]


def fixture_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id as id",
        "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as t0",
        "user_id as u",
        "user_id % 12 as op",
        "event_type as et",
        "cast(get_json_object(props, '$.k') as bigint) as k",
        "cast(round(value * 100) as bigint) as cents",
    ).withColumn("q", F.expr("(t0 div 10800) * 10800 + (op div 2) * 600"))
    own = base.selectExpr(
        "id * 2 + 1 as sig",
        "q + if(et in ('view', 'signup'), id % 240, 0) as ts",
        """case when et in ('error', 'view') then concat('S', u) when et = 'purchase' then concat('F', op, '_', k % 3)
           else concat('X', op, '_', id div 60) end as fee_payer""",
        "concat('S', u) as source",
        """case et when 'error' then concat('S', u) when 'signup' then concat('R', u, '_', k % 2)
           when 'view' then concat('X', op, '_', id div 60 + 1) when 'click' then concat('E', k % 10)
           when 'purchase' then concat('H', op, '_', u div 48) end as dest""",
        "if(et = 'error', 0, cents) as amount",
        "case et when 'error' then 'memo' when 'click' then 'swap' when 'purchase' then 'stake' else 'transfer' end as kind",
        "if(et = 'view' and k % 2 = 0, null, op) as operator",
    )
    onward = base.filter("(et = 'purchase' and k % 5 = 0) or (et = 'signup' and k % 3 = 0)").selectExpr(
        "id * 2 + 2 as sig",
        "q + 300 + k as ts",
        "concat('Y', id) as fee_payer",
        "if(et = 'purchase', concat('H', op, '_', u div 48), concat('R', u, '_', k % 2)) as source",
        "concat('E', k % 10) as dest",
        "cents - cents * (k % 4) div 400 as amount",
        "'consolidate' as kind",
        "op as operator",
    )
    return with_position(own.unionByName(onward), "ts", ["sig"], "slot").withColumn("pos", F.col("slot")).select(*COLUMNS)

"""Interchange forms of a ledger: one JSON document, a JSON-lines journal, and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import account_bytes, account_hex

RECORD = (
    "sig decimal(20,0), slot decimal(20,0), ts bigint, fee_payer array<smallint>, source array<smallint>, "
    "dest array<smallint>, amount decimal(20,0), kind string, operator bigint"
)
LONG_MAX = 2**63 - 1


def _engine(rows: DataFrame) -> DataFrame:
    """File form to engine form; a value beyond the range of a long is an error, never a silent NULL."""
    whole = lambda c: F.when(F.col(c) > LONG_MAX, F.raise_error(F.lit(f"{c} exceeds 2^63-1")).cast("long")).otherwise(F.col(c).cast("long")).alias(c)
    return rows.select(
        whole("sig"),
        whole("slot"),
        "ts",
        *(account_hex(F.col(c)).alias(c) for c in ("fee_payer", "source", "dest")),
        whole("amount"),
        "kind",
        "operator",
        "pos",
    )


def _file(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        "sig", "slot", "ts", *(account_bytes(F.col(c)).alias(c) for c in ("fee_payer", "source", "dest")), "amount", "kind", "operator"
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A whole-document ledger, ``{"records": [...]}``."""
    doc = spark.read.schema(f"records array<struct<{RECORD}>>")
    rows = doc.option("multiLine", True).json(path).select(F.posexplode("records").alias("pos", "r"))
    return _engine(rows.select(F.col("pos").cast("long"), "r.*"))


def ledger_document(ledger: DataFrame) -> DataFrame:
    """One row holding the JSON document; for interchange of small ledgers only."""
    fields = F.struct("sig", "slot", "ts", "fee_payer", "source", "dest", "amount", "kind", "operator")
    rows = ledger.withColumns({c: account_bytes(F.col(c)) for c in ("fee_payer", "source", "dest")})
    rows = rows.select("pos", F.to_json(fields, {"ignoreNullFields": "false"}).alias("j"))
    body = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("pos", "j"))), lambda x: x["j"]))
    return rows.agg(F.concat(F.lit('{"records":['), body, F.lit("]}")).alias("value"))


def append_journal(ledger: DataFrame, path: str) -> None:
    """Add the records to a JSON-lines journal."""
    _file(ledger).write.mode("append").option("ignoreNullFields", "false").json(path)


def read_journal(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """The committed prefix of a journal: records 1 to ``count``; too few of them is an error.

    Torn or uncommitted lines beyond the count are ignored.
    """
    rows = spark.read.text(path).select(F.from_json("value", RECORD).alias("r")).filter("r.sig is not null").select("r.*")
    if count is not None:
        rows = rows.filter(F.col("sig") <= count)
        found = rows.select("sig").distinct().count()
        if found < count:
            raise ValueError(f"journal holds {found} of {count} committed records")
    return _engine(rows.withColumn("pos", F.col("sig").cast("long")))

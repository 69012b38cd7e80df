"""What the ledger's records cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cost(ledger: DataFrame, lamports_per_signature: int = 5_000) -> DataFrame:
    """One row: transactions, signatures (two where another account pays), fees and the amount moved."""
    signed = F.when(F.col("fee_payer") == F.col("source"), 1).otherwise(2)
    whole = lambda c, out: F.coalesce(F.sum(c.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(out)
    return ledger.agg(
        F.count(F.lit(1)).alias("transactions"), whole(signed, "signatures"), whole(F.col("amount"), "transferred")
    ).select(
        "transactions",
        "signatures",
        (F.col("signatures") * F.lit(lamports_per_signature)).cast("decimal(38,0)").alias("estimated_fees"),
        "transferred",
    )


def fingerprint(ledger: DataFrame, chunk: int = 100_000) -> DataFrame:
    """One row: a digest of all records in order, hashed per chunk of positions and then over the chunks.

    A Spark-specific form: each chunk has a fixed number of rows, and only
    chunk digests are brought together.
    """
    row = F.sha2(
        F.concat_ws("|", "sig", "slot", "ts", "fee_payer", "source", "dest", "amount", "kind", F.coalesce(F.col("operator"), F.lit(4_294_967_295))),
        256,
    )
    joined = lambda c: F.sha2(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(c)), lambda x: x["h"])), 256
    )
    chunks = (
        ledger.select("pos", row.alias("h"), F.floor(F.col("pos") / chunk).alias("c"))
        .groupBy("c")
        .agg(joined(F.struct("pos", "h")).alias("h"))
    )
    return chunks.agg(joined(F.struct("c", "h")).alias("fingerprint"))

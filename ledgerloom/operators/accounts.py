"""Account universe, ownership labels and the label firewall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL_COLUMNS = ("operator", "kind")


def public(ledger: DataFrame) -> DataFrame:
    """The only form of the ledger that edge and feature builders see: no labels, no intent."""
    return ledger.drop(*LABEL_COLUMNS)


def accounts(ledger: DataFrame) -> DataFrame:
    every = F.explode(F.array("fee_payer", "source", "dest")).alias("account")
    return ledger.select(every).filter("account is not null").distinct()


def ownership(labelled: DataFrame) -> DataFrame:
    """Owner of each labelled source; the last label in record order wins."""
    return (
        labelled.filter("operator is not null and source is not null")
        .groupBy(F.col("source").alias("account"))
        .agg(F.max_by("operator", "pos").alias("operator"))
    )


def payer_ownership(labelled: DataFrame) -> DataFrame:
    """Operator of each sponsoring fee payer; the last sponsored, labelled record wins."""
    return (
        labelled.filter("operator is not null and fee_payer <> source")
        .groupBy("fee_payer")
        .agg(F.max_by("operator", "pos").alias("operator"))
    )

"""Throwaway fee payers and the funding transfers that go with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import with_position

POLICIES = ("none", "operator_hub", "dedicated", "shared_relayers")


@dataclass(frozen=True)
class FundingConfig:
    policy: str = "none"
    relayers: int = 12
    sticky: bool = True
    lead_min_secs: int = 30
    lead_max_secs: int = 900
    topup_min: int = 20_000
    topup_max: int = 60_000


def throwaway_payers(ledger: DataFrame) -> DataFrame:
    """First use, in record order, of each fee payer that never acts as a source."""
    acting = ledger.select(F.col("source").alias("fee_payer")).distinct()
    first = F.row_number().over(W.partitionBy("fee_payer").orderBy("pos"))
    return (
        ledger.join(acting, "fee_payer", "left_anti")
        .withColumn("_n", first)
        .filter("_n = 1")
        .select("fee_payer", "ts", "pos", "operator")
    )


def apply_funding(ledger: DataFrame, cfg: FundingConfig, seed: int = 1, hubs: DataFrame | None = None) -> DataFrame:
    """Append one top-up per throwaway payer; all earlier records stay as they are.

    Each top-up lies a drawn lead before the payer's first use. An operator's
    hub is its account in ``hubs`` (operator, hub), else the source of its
    first record. Relayers serve many operators, so their top-ups carry no
    operator. Choices are drawn from a keyed hash of the payer, so they do not
    depend on the partitioning.
    """
    if cfg.policy not in POLICIES:
        raise ValueError(f"unknown funding policy {cfg.policy!r}")
    if cfg.policy == "none":
        return ledger
    draw = lambda what, n: F.pmod(F.xxhash64(F.lit(f"{seed}:{what}"), *(
        [F.col("fee_payer")] if what != "relayer" or not cfg.sticky else [F.col("operator")]
    )), F.lit(n))
    shared = cfg.policy == "shared_relayers"
    payers = throwaway_payers(ledger).filter("operator is not null")
    if cfg.policy == "operator_hub":
        if hubs is None:
            acting = ledger.filter("operator is not null")
            hubs = acting.groupBy("operator").agg(F.min_by("source", "pos").alias("hub"))
        payers, funder = payers.join(hubs, "operator"), F.col("hub")
    elif shared:
        funder = F.sha2(F.concat(F.lit(f"{seed}:relayer:"), draw("relayer", max(cfg.relayers, 1))), 256)
    else:
        funder = F.sha2(F.concat(F.lit(f"{seed}:funder:"), F.col("operator")), 256)
    lead = cfg.lead_min_secs + draw("lead", max(cfg.lead_max_secs - cfg.lead_min_secs, 0) + 1)
    topups = payers.select(
        (F.col("ts") - lead).alias("ts"),
        funder.alias("source"),
        F.col("fee_payer").alias("dest"),
        (cfg.topup_min + draw("amount", max(cfg.topup_max - cfg.topup_min, 0) + 1)).cast("long").alias("amount"),
        F.lit("transfer").alias("kind"),
        (F.lit(None) if shared else F.col("operator")).cast(ledger.schema["operator"].dataType).alias("operator"),
    ).filter("source <> dest")
    last = ledger.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(f"_{c}") for c in ("sig", "slot", "pos")))
    numbered = with_position(topups, "ts", ["dest"], "_i").join(F.broadcast(last))
    suffix = numbered.select(
        *((F.col(f"_{c}") + F.col("_i")).alias(c) for c in ("sig", "slot", "pos")),
        "ts",
        F.col("source").alias("fee_payer"),
        "source",
        "dest",
        "amount",
        "kind",
        "operator",
    )
    return ledger.unionByName(suffix.select(*ledger.columns))

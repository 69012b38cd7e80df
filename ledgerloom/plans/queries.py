"""The registered queries over the fixture ledger, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import LearnConfig, LinkConfig
from ..operators import accounts as acc
from ..operators import edges as ed
from ..operators.clusters import close, cluster, sizes
from ..operators.cost import cost, fingerprint
from ..operators.features import FEATURES, pair_features
from ..operators.funding import FundingConfig, apply_funding, throwaway_payers
from ..operators.generator import GenConfig, generate
from ..operators.groups import burst_groups, dest_episodes, window_groups
from ..operators.learned import labelled_pairs, learned_attribution, learned_weights, roc_auc
from ..operators.metrics import funder_anonymity, funding_records, purity
from ..sources.fixture import fixture_ledger
from ..sources.personas import presets
from ..storage import written
from . import oracle as sql
from .analysis import analyze, rounded, window_sweep, worst_case

EXACT, WINDOWED, FUNDER = LinkConfig.exact_ts(), LinkConfig.windowed(120), LinkConfig.funder_aware(120)
ONLY = {
    "fee": replace(LinkConfig.nothing(), use_fee_payer=True),
    "cospend": replace(LinkConfig.nothing(), use_cospend=True),
    "activation": replace(LinkConfig.nothing(), use_activation_lineage=True),
    "exact": EXACT,
    "windowed": WINDOWED,
    "funder_aware": FUNDER,
}


def _on(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(fixture_ledger(spark, sf_dir))


def _settled(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """For analyses that read the ledger many times: it is derived from events, so it is written once."""
    return lambda spark, sf_dir: f(written(fixture_ledger(spark, sf_dir), "ledger"))


def _seen(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return _on(lambda ledger: f(acc.public(ledger)))


def _weighted(pairs: DataFrame, least: int) -> DataFrame:
    return pairs.filter(F.col("w") >= least).select("a", "b", "w")


def _report(ledger: DataFrame, cfg: LinkConfig) -> DataFrame:
    return rounded(analyze(ledger, cfg)[1])


def _burst_summary(ledger: DataFrame) -> DataFrame:
    per = burst_groups(acc.public(ledger)).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources")
    )
    return per.agg(
        F.count(F.lit(1)).alias("bursts"), F.max("n").alias("largest"), F.sum("sources").alias("source_rows")
    )


def _features(ledger: DataFrame) -> DataFrame:
    return rounded(pair_features(acc.public(ledger), acc.ownership(ledger), LearnConfig()))


def _single_auc(ledger: DataFrame) -> DataFrame:
    pairs = labelled_pairs(ledger, LearnConfig())
    stacked = f"stack({len(FEATURES)}, {', '.join(f'{f!r}, round({f}, 6)' for f in FEATURES)}) as (feature, score)"
    return rounded(roc_auc(pairs.select("y", F.expr(stacked)), "score", "y", ["feature"]))


def _monotone(ledger: DataFrame) -> DataFrame:
    """Records whose ts lies before that of the record in front; a day's first row is compared by slot as well."""
    day = F.floor(F.col("slot") / 100_000)
    ends = ledger.groupBy(day.alias("c")).agg(F.max_by("ts", "slot").alias("last"))
    prev_chunk = ends.select((F.col("c") + 1).alias("c"), F.col("last").alias("_carried"))
    rows = ledger.withColumn("c", day).join(prev_chunk, "c", "left")
    before = F.coalesce(F.lag("ts").over(W.partitionBy("c").orderBy("slot")), F.col("_carried"))
    return rows.select((F.col("ts") < before).alias("bad")).agg(F.count_if("bad").alias("violations"))


def _funding_suffix(ledger: DataFrame) -> DataFrame:
    return throwaway_payers(ledger).select("fee_payer", F.col("ts").alias("first_ts"), F.col("pos").alias("first_pos"), "operator")


def _funded_stats(ledger: DataFrame) -> DataFrame:
    funded = apply_funding(ledger, FundingConfig("operator_hub"))
    return funded.agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last_slot")
    )


def _generated(spark: SparkSession, _: str) -> DataFrame:
    ledger = generate(spark, presets(), GenConfig(agents=6, days=1))
    return ledger.groupBy("operator").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source").alias("sources"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "ledger_view": _on(lambda x: x),
        "accounts_distinct": _seen(acc.accounts),
        "ownership_last_label": _on(acc.ownership),
        "payer_ownership": _on(acc.payer_ownership),
        "burst_groups": _seen(lambda p: burst_groups(p).select("sig", "group_id")),
        "burst_summary": _on(_burst_summary),
        **{
            f"window_groups_{w}": _seen(lambda p, w=w: window_groups(p, w).select("sig", "group_id"))
            for w in (0, 120, 600)
        },
        "dest_episodes_120": _seen(lambda p: dest_episodes(p, 120).select("sig", "dest", "group_id")),
        "edges_fee_payer": _seen(lambda p: ed.canonical(ed.fee_payer_edges(p))),
        "edges_cospend": _seen(lambda p: ed.canonical(ed.cospend_edges(p, EXACT))),
        "edges_peel": _seen(lambda p: ed.canonical(ed.peel_matches(p, 120, 50))),
        "edges_peel_600": _seen(lambda p: ed.canonical(ed.peel_matches(p, 600, 50))),
        "edges_activation": _seen(lambda p: ed.canonical(ed.activation_records(p, 172_800))),
        "edges_copay_exact": _seen(lambda p: _weighted(ed.copay_edges(burst_groups(p), EXACT), 2)),
        "edges_copay_windowed": _seen(lambda p: _weighted(ed.windowed_copay_edges(p, WINDOWED), 3)),
        "edges_coact": _seen(lambda p: _weighted(ed.coact_edges(burst_groups(p), EXACT), 3)),
        "edges_ceiling": _seen(lambda p: ed.canonical(ed.ceiling_edges(burst_groups(p), EXACT))),
        "funding_edges": _seen(ed.funding_edges),
        "edges_funder": _seen(lambda p: ed.canonical(ed.funder_edges(p, FUNDER))),
        **{f"clusters_{name}": _settled(lambda x, c=c: cluster(x, c)) for name, c in ONLY.items()},
        "cluster_sizes_fee": _settled(lambda x: sizes(cluster(x, ONLY["fee"]))),
        **{f"report_{name}": _settled(lambda x, c=c: _report(x, c)) for name, c in ONLY.items()},
        "window_sweep": _settled(lambda x: rounded(window_sweep(x))),
        "worst_case_f1": _settled(lambda x: rounded(worst_case(x))),
        "purity_by_group": _on(lambda x: purity(burst_groups(x), "", by_group=True)),
        "funding_records": _on(lambda x: funding_records(x).select("sig", "source", "dest")),
        "funder_anonymity": _on(funder_anonymity),
        "cost_estimate": _on(
            lambda x: cost(x).select(*(F.col(c).cast("long").alias(c) for c in ("transactions", "signatures", "estimated_fees", "transferred")))
        ),
        "ledger_fingerprint": _on(fingerprint),
        "pair_features": _settled(_features),
        "single_feature_auc": _settled(_single_auc),
        "learned_attribution": _settled(lambda x: rounded(learned_attribution(x)[1])),
        "learned_weights": _settled(lambda x: rounded(learned_weights(x))),
        "learned_clusters": _settled(lambda x: learned_attribution(x)[0]),
        "monotone_time_violations": _on(_monotone),
        "throwaway_payers": _on(_funding_suffix),
        "funding_suffix_base": _on(_funded_stats),
        "generated_ledger_stats": _generated,
    }
    return out


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql(queries())


__all__ = ["close", "oracle_sql", "queries"]

"""The linking rules: each turns the public ledger into undirected edges (a, b)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.scalars import tolerance
from .groups import burst_groups, window_groups
from .ordering import session_starts

VALUE_MOVE = "amount > 0 and source <> dest"
SPONSORED = "fee_payer <> source"


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs without loops."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def active_sources(public: DataFrame) -> DataFrame:
    return public.select(F.col("source").alias("dest")).distinct()


def gated(members: DataFrame, bucket: list[str], at_least: int, at_most: int | None = None) -> DataFrame:
    """Distinct (bucket, source) rows of the buckets whose distinct-source count lies in the range.

    The gate runs before any pair is built; the count is a plain aggregate.
    """
    members = members.select(*bucket, "source").distinct()
    sizes = members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
    if at_most is not None:
        sizes = sizes.filter(F.col("_n") <= at_most)
    return members.join(sizes.select(*bucket), bucket, "left_semi")


def pairs_within(members: DataFrame, bucket: list[str], id_col: str = "source") -> DataFrame:
    """Ordered pairs a < b that share a bucket, one row per shared bucket. Buckets are gated or bounded by the caller."""
    left = members.select(*bucket, F.col(id_col).alias("a"))
    right = members.select(*bucket, F.col(id_col).alias("b"))
    return left.join(right, bucket).filter("a < b").select("a", "b")


def _shared(members: DataFrame, bucket: list[str]) -> DataFrame:
    return pairs_within(members, bucket).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))


def fee_payer_edges(public: DataFrame) -> DataFrame:
    return public.select(F.col("fee_payer").alias("a"), F.col("source").alias("b"))


def cospend_edges(public: DataFrame, cfg: LinkConfig) -> DataFrame:
    paid = public.filter(VALUE_MOVE).join(active_sources(public), "dest", "left_semi")
    return gated(paid, ["dest"], 2, cfg.burst_max_sources).select(F.col("dest").alias("a"), F.col("source").alias("b"))


def peel_matches(public: DataFrame, window_secs: int, bps: int) -> DataFrame:
    """Chains a then b: b spends at a's destination, soon after and nearly the same amount.

    A band join: besides the account, the key holds a time bucket as wide as
    the window, so a busy account splits into many small groups; each first leg
    probes its own bucket and the next.
    """
    window_secs, width = max(window_secs, 0), max(window_secs, 1)
    legs = public.filter(VALUE_MOVE)
    bucket = lambda ts: F.floor(ts / width)
    first = legs.select(
        F.col("sig").alias("sig_a"),
        F.col("ts").alias("ts_a"),
        F.col("source").alias("a"),
        F.col("dest").alias("hub"),
        F.col("amount").alias("amount_a"),
        F.explode(F.array(bucket(F.col("ts")), bucket(F.col("ts")) + 1)).alias("_slice"),
    )
    second = legs.select(
        F.col("sig").alias("sig_b"),
        F.col("ts").alias("ts_b"),
        F.col("source").alias("hub"),
        F.col("dest").alias("b"),
        F.col("amount").alias("amount_b"),
        bucket(F.col("ts")).alias("_slice"),
    )
    gap = F.abs(F.col("amount_a").cast("decimal(20,0)") - F.col("amount_b").cast("decimal(20,0)"))
    return (
        first.join(second, ["hub", "_slice"])
        .filter(F.col("ts_b").between(F.col("ts_a"), F.col("ts_a") + window_secs))
        .filter("sig_a <> sig_b")
        .filter(gap <= tolerance(F.col("amount_a"), bps))
        .select("a", "b")
    )


def activation_records(public: DataFrame, window_secs: int) -> DataFrame:
    """Payments to an account shortly before it first acts; one row per payment."""
    first = public.groupBy(F.col("source").alias("dest")).agg(F.min("ts").alias("_first"))
    return (
        public.filter(VALUE_MOVE)
        .join(first, "dest")
        .filter((F.col("_first") - F.col("ts")).between(0, max(window_secs, 0)))
        .select(F.col("source").alias("a"), F.col("dest").alias("b"))
    )


def copay_edges(grouped: DataFrame, cfg: LinkConfig) -> DataFrame:
    """Weighted pairs that pay one destination in the same group."""
    paid = grouped.filter(F.col("amount") >= cfg.copay_min_amount)
    return _shared(
        gated(paid, ["group_id", "dest"], cfg.copay_min_sources, cfg.burst_max_sources), ["group_id", "dest"]
    )


def windowed_copay_edges(public: DataFrame, cfg: LinkConfig) -> DataFrame:
    """The same over per-destination episodes, for destinations that act themselves."""
    paid = public.filter(F.col("amount") >= cfg.copay_min_amount).join(active_sources(public), "dest", "left_semi")
    episodes = paid.join(session_starts(paid, ["dest"], cfg.window_secs), ["dest", "ts"])
    return copay_edges(episodes, cfg)


def coact_edges(bursts: DataFrame, cfg: LinkConfig) -> DataFrame:
    """Weighted pairs of sponsored sources that act in the same bursts, whatever the destination."""
    return _shared(gated(bursts.filter(SPONSORED), ["group_id"], 2, cfg.burst_max_sources), ["group_id"])


def funding_edges(public: DataFrame) -> DataFrame:
    """(funder, fee_payer): accounts that pay an account which pays fees."""
    payers = public.select(F.col("fee_payer").alias("dest")).distinct()
    return (
        public.filter("source <> dest")
        .join(payers, "dest", "left_semi")
        .select(F.col("source").alias("funder"), F.col("dest").alias("fee_payer"))
        .distinct()
    )


def funded_sources(public: DataFrame, min_fundees: int) -> DataFrame:
    """Distinct (funder, source) over two hops, for funders of at least so many fee payers."""
    funding = funding_edges(public)
    many = funding.groupBy("funder").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_fundees)
    sponsored = public.filter(SPONSORED).select("fee_payer", "source").distinct()
    return (
        funding.join(many.select("funder"), "funder", "left_semi")
        .join(sponsored, "fee_payer")
        .select("funder", "source")
        .distinct()
    )


def funder_edges(public: DataFrame, cfg: LinkConfig) -> DataFrame:
    reached = funded_sources(public, cfg.funder_min_fundees)
    return gated(reached, ["funder"], 2, cfg.funder_max_sources).select(
        F.col("funder").alias("a"), F.col("source").alias("b")
    )


def ceiling_edges(grouped: DataFrame, cfg: LinkConfig) -> DataFrame:
    """Ablation: all sources of a group at once, as a star around its smallest source."""
    members = gated(grouped, ["group_id"], 2, cfg.burst_max_sources)
    centre = members.groupBy("group_id").agg(F.min("source").alias("a"))
    return members.join(centre, "group_id").select("a", F.col("source").alias("b"))


#: More rules can be added here: name to function(public, cfg) -> DataFrame[a, b].
EXTRA_RULES: dict = {}


def rule_edges(public: DataFrame, cfg: LinkConfig) -> DataFrame | None:
    """All edges of the enabled rules as one lazy plan; None when no rule is on."""
    found: list[DataFrame] = []
    if cfg.use_fee_payer:
        found.append(fee_payer_edges(public))
    if cfg.use_cospend:
        found.append(cospend_edges(public, cfg))
    if cfg.use_temporal_amount:
        found.append(peel_matches(public, cfg.temporal_window_secs, cfg.amount_tolerance_bps))
    if cfg.use_activation_lineage:
        found.append(activation_records(public, cfg.activation_window_secs))
    if cfg.use_burst_copay:
        pairs = windowed_copay_edges(public, cfg) if cfg.use_windowed else copay_edges(burst_groups(public), cfg)
        found.append(pairs.filter(F.col("w") >= cfg.copay_min_shared_buckets).select("a", "b"))
    if cfg.use_burst_coactivity:
        pairs = coact_edges(burst_groups(public), cfg)
        found.append(pairs.filter(F.col("w") >= cfg.coactivity_min_shared_bursts).select("a", "b"))
    if cfg.use_funder_graph:
        found.append(funder_edges(public, cfg))
    if cfg.use_burst_union_ceiling:
        grouped = window_groups(public, cfg.window_secs) if cfg.use_windowed else burst_groups(public)
        found.append(ceiling_edges(grouped, cfg))
    found.extend(rule(public, cfg).select("a", "b") for rule in EXTRA_RULES.values())
    return reduce(DataFrame.unionByName, found) if found else None

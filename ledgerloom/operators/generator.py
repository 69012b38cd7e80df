"""Synthetic labelled ledgers: one group per agent, then one global clock.

Agents act on their own logical time, so they are generated in parallel; the
observable clock, on which a wake starts when the one before has ended, is a
scan over days.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.personas import Persona
from .funding import FundingConfig, apply_funding
from .ordering import DAY, with_position

MODES = ("naive", "legacy", "cooker")
REBALANCE = ("rotate", "consolidate")


@dataclass(frozen=True)
class Hardening:
    intra_gap_secs: float = 7.0
    maintenance: float = 0.03
    sweep_min: int = 2
    sweep_max: int = 3
    hold_aggregate_rate: bool = True
    rebalance: str = "rotate"


@dataclass(frozen=True)
class GenConfig:
    agents: int = 12
    days: int = 3
    start: int = 1_700_000_000
    mode: str = "cooker"
    seed: int = 1
    externals: int = 40
    hardening: Hardening = Hardening()
    funding: FundingConfig = field(default_factory=FundingConfig)

    def validate(self) -> GenConfig:
        """The checked configuration with names in lower case, as every later step compares them."""
        if min(self.agents, self.days, self.externals) <= 0:
            raise ValueError("agents, days and externals must be positive")
        if self.start + self.days * DAY >= 2**62:
            raise ValueError("days overflow")
        plain = replace(self, mode=self.mode.lower(), hardening=replace(self.hardening, rebalance=self.hardening.rebalance.lower()))
        if plain.mode not in MODES or plain.hardening.rebalance not in REBALANCE:
            raise ValueError("unknown mode or rebalance strategy")
        return plain


def account(*what) -> str:
    return hashlib.sha256(":".join(map(str, what)).encode()).hexdigest()


def split_amount(total: int, persona: Persona, rng: np.random.Generator) -> list[int]:
    """Random parts of at least the floor that add up to the total."""
    s = persona.split
    if total <= 0:
        return []
    if total <= s.min_part_lamports:
        return [total]
    n = max(1, min(int(rng.integers(s.min_parts, s.max_parts + 1)), total // s.min_part_lamports))
    spare = total - n * s.min_part_lamports
    weights = rng.random(n) + 0.01
    parts = s.min_part_lamports + np.floor(spare * (weights / weights.sum())).astype(np.int64)
    parts[int(rng.integers(n))] += total - int(parts.sum())
    return [int(x) for x in parts]


def num_decoys(persona: Persona, rng: np.random.Generator) -> int:
    rate = persona.decoy.decoys_per_real
    return min(int(rng.poisson(rate)), 64) if rate > 0 else 0


def next_delay(persona: Persona, second_of_day: int, rng: np.random.Generator, slower: float = 1.0) -> int:
    c = persona.circadian
    top = max(c.hourly_weights)
    weight = max(c.hourly_weights[int(second_of_day // 3600) % 24] / top, 0.01)
    mean = 3600.0 / max(c.actions_per_active_hour * weight, 0.05) * slower
    return max(1, round(rng.exponential(mean) * rng.uniform(1 - c.jitter, 1 + c.jitter)))


def choose_action(persona: Persona, rng: np.random.Generator) -> str:
    kinds = sorted(persona.action_weights)
    w = np.array([persona.action_weights[k] for k in kinds])
    return str(rng.choice(kinds, p=w / w.sum()))


def sample_amount(persona: Persona, rng: np.random.Generator) -> int:
    return max(1, round(float(rng.lognormal(np.log(persona.base_amount_lamports), persona.amount_sigma))))


class _Agent:
    """One operator's accounts and its records, wake by wake."""

    def __init__(self, i: int, persona: Persona, cfg: GenConfig):
        self.i, self.p, self.cfg = i, persona, cfg
        self.rng = np.random.default_rng([cfg.seed, i])
        self.subs = [account(cfg.seed, "sub", i, k) for k in range(persona.num_subaccounts)]
        self.made, self.out = 0, []

    def fresh(self, what: str) -> str:
        self.made += 1
        return account(self.cfg.seed, what, self.i, self.made)

    def external(self) -> str:
        return account(self.cfg.seed, "ext", int(self.rng.integers(self.cfg.externals)))

    def emit(self, payer: str, source: str, dest: str, amount: int, kind: str) -> None:
        gap = 1
        if self.cfg.mode == "cooker":
            gap = max(1, round(float(self.rng.exponential(self.cfg.hardening.intra_gap_secs))))
        self.out.append((payer, source, dest, int(amount), kind, gap))

    def plan(self, kind: str, source: str, parts: list[int], source_of=lambda s: s) -> None:
        naive = self.cfg.mode == "naive"
        for amount in parts or [0]:
            sender = source_of(source)
            payer = self.subs[0] if naive else self.fresh("payer")
            if kind == "memo" or amount == 0:
                self.emit(payer, sender, sender, 0, kind)
            else:
                self.emit(payer, sender, self.external(), amount, kind)

    def wake(self, slot: int) -> None:
        rng, p, cfg = self.rng, self.p, self.cfg
        kind, total = choose_action(p, rng), sample_amount(p, rng)
        if cfg.mode == "cooker":
            if rng.random() < cfg.hardening.maintenance:
                return self.maintain()
            return self.plan(kind, self.subs[slot % len(self.subs)], [] if kind == "memo" else [total])
        any_sub = lambda: self.subs[int(rng.integers(len(self.subs)))]
        if cfg.mode == "naive":
            self.plan(kind, any_sub(), [] if kind == "memo" else [total])
            if rng.random() < 0.12 and len(self.subs) > 1:
                self.emit(self.subs[0], self.subs[int(rng.integers(1, len(self.subs)))], self.subs[0], sample_amount(p, rng), "consolidate")
            return None
        self.plan(kind, any_sub(), [] if kind == "memo" else split_amount(total, p, rng), lambda _: any_sub())
        for _ in range(num_decoys(p, rng)):
            self.emit(self.fresh("payer"), any_sub(), self.external(), int(rng.integers(1, p.decoy.dust_lamports_max + 1)), "dust")
        if rng.random() < 0.08:
            self.emit(self.fresh("payer"), any_sub(), self.fresh("store"), sample_amount(p, rng), "consolidate")
        return None

    def maintain(self) -> None:
        h, rng = self.cfg.hardening, self.rng
        others = np.arange(1, len(self.subs))
        k = min(len(others), int(rng.integers(h.sweep_min, h.sweep_max + 1)))
        for at in rng.permutation(others)[:k]:
            old = self.subs[at]
            heir = self.fresh("heir") if h.rebalance == "rotate" else self.subs[0]
            self.emit(self.fresh("payer"), old, heir, sample_amount(self.p, rng), "consolidate")
            if h.rebalance == "rotate":
                self.subs[at] = heir

    def run(self) -> pd.DataFrame:
        cfg, rng = self.cfg, self.rng
        end = cfg.start + cfg.days * DAY
        clocks = len(self.subs) if cfg.mode == "cooker" else 1
        slower = float(clocks) if cfg.mode == "cooker" and cfg.hardening.hold_aggregate_rate else 1.0
        due = [cfg.start + (int(rng.integers(3600)) if clocks > 1 else 0) + next_delay(self.p, cfg.start % DAY, rng, slower) for _ in range(clocks)]
        rows, n = [], 0
        while (at := min(due)) < end:
            slot = due.index(at)
            due[slot] = at + next_delay(self.p, at % DAY, rng, slower)
            self.out = []
            self.wake(slot)
            rows += [(self.i, n, at, r, *rec) for r, rec in enumerate(self.out)]
            n += 1
        names = ["operator", "wake", "best", "rec", "fee_payer", "source", "dest", "amount", "kind", "gap"]
        return pd.DataFrame(rows, columns=names)


def _clock(records: DataFrame) -> DataFrame:
    """Give each record its observable ts: start = max(best, end of the wake before), over all agents.

    In the running form, end = max over j up to i of (best_j + durations j to i):
    a sum and a maximum per day, and the same over the table of days.
    """
    wakes = records.groupBy("best", "operator", "wake").agg(F.sum("gap").alias("dur")).withColumn(
        "_day", F.floor(F.col("best") / DAY)
    )
    order = W.partitionBy("_day").orderBy("best", "operator", "wake").rowsBetween(W.unboundedPreceding, 0)
    scan = wakes.withColumn("_d", F.sum("dur").over(order))
    scan = scan.withColumn("_m", F.max(F.col("best") - (F.col("_d") - F.col("dur"))).over(order))
    days = scan.groupBy("_day").agg(F.max("_d").alias("_dd"), F.max("_m").alias("_mm"))
    up = W.orderBy("_day").rowsBetween(W.unboundedPreceding, 0)
    before = W.orderBy("_day")
    days = (
        days.withColumn("_sum", F.sum("_dd").over(up))
        .withColumn("_end", F.max(F.col("_mm") + F.col("_dd") - F.col("_sum")).over(up) + F.col("_sum"))
        .select("_day", F.lag("_end").over(before).alias("_from"))
    )
    starts = scan.join(F.broadcast(days), "_day").select(
        "best",
        "operator",
        "wake",
        (F.greatest(F.col("_m"), F.coalesce("_from", F.col("_m"))) + F.col("_d") - F.col("dur")).alias("_start"),
    )
    inside = F.sum("gap").over(
        W.partitionBy("best", "operator", "wake").orderBy("rec").rowsBetween(W.unboundedPreceding, -1)
    )
    return records.join(starts, ["best", "operator", "wake"]).withColumn(
        "ts", F.col("_start") + F.coalesce(inside, F.lit(0))
    )


def generate(spark: SparkSession, personas: list[Persona], cfg: GenConfig) -> DataFrame:
    """A labelled ledger; the same seed gives the same rows however it is partitioned."""
    cfg = cfg.validate()
    profiles = [p.validate() for p in personas]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["operator"].iloc[0])
        return _Agent(i, profiles[i % len(profiles)], cfg).run()

    schema = (
        "operator long, wake long, best long, rec int, fee_payer string, source string, dest string, "
        "amount long, kind string, gap long"
    )
    agents = spark.range(cfg.agents).select(F.col("id").alias("operator"))
    timed = _clock(agents.groupBy("operator").applyInPandas(run, schema))
    numbered = with_position(timed, "ts", ["best", "operator", "wake", "rec"], "slot")
    ledger = numbered.select(
        F.col("slot").alias("sig"), "slot", "ts", "fee_payer", "source", "dest", "amount", "kind", "operator", F.col("slot").alias("pos")
    )
    if cfg.mode == "naive":
        return ledger
    hub = F.sha2(F.concat(F.lit(f"{cfg.seed}:sub:"), F.col("operator"), F.lit(":0")), 256)  # each agent's first account
    return apply_funding(ledger, cfg.funding, cfg.seed, agents.select("operator", hub.alias("hub")))


def run_comparison(spark: SparkSession, personas: list[Persona], cfg: GenConfig) -> tuple[DataFrame, DataFrame]:
    """The same seed in naive and hardened form."""
    return generate(spark, personas, replace(cfg, mode="naive")), generate(spark, personas, replace(cfg, mode="cooker"))

"""The learned linker, funding, generator modes and reports against plain forms."""

import json
from dataclasses import replace
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.config import LearnConfig
from ledgerloom.operators.funding import FundingConfig, apply_funding
from ledgerloom.operators.generator import GenConfig, Hardening, account, generate, run_comparison
from ledgerloom.operators import condensed, features, learned
from ledgerloom.operators.condensed import Rows, bins_for, condense, ratio_auc
from ledgerloom.operators.learned import Logistic, cross_validate, labelled_pairs, learned_attribution, learned_weights, roc_auc
from ledgerloom.operators.accounts import ownership, public
from ledgerloom.operators.features import FEATURES, pair_features
from ledgerloom.plans.analysis import report, verdict
from ledgerloom.plans.queries import queries
from ledgerloom.sources.fixture import fixture_ledger
from ledgerloom.sources.personas import presets
from ledgerloom.sources.reports import report_document, text_table, write_report
from ledgers import ledger
from ledgerloom.storage import scratch_scope, written


def plain_model(x, y, cfg):
    """Weighted logistic regression by the book, one sum at a time."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std < 1e-9] = 1.0
    z, w, bias = (x - mean) / std, np.zeros(x.shape[1]), 0.0
    weight = np.where(y == 1, (y == 0).sum() / max((y == 1).sum(), 1), 1.0)
    for _ in range(cfg.iterations):
        error = weight * (1 / (1 + np.exp(-(z @ w + bias))) - y)
        w, bias = w - cfg.learning_rate * ((error[:, None] * z).sum(axis=0) + cfg.l2 * w) / weight.sum(), bias - cfg.learning_rate * error.sum() / weight.sum()
    return lambda v: 1 / (1 + np.exp(-(((v - mean) / std) @ w + bias)))


def plain_auc(p, y):
    """Share of (positive, negative) pairs in the right order, ties at half."""
    won = [(a > b) + 0.5 * (a == b) for a, b in product(p[y == 1], p[y == 0])]
    return float(np.mean(won))


@pytest.fixture(scope="module")
def small(spark):
    """The accounts of a small part of the fixture, so that all pairs can be compared in plain Python."""
    full = fixture_ledger(spark, "/root/testdata/sf0.001")
    return written(full.filter("crc32(source) % 3 = 0"), "small")


def test_learned_linker_against_plain_models(spark, small):
    cfg = LearnConfig(folds=3, iterations=60)
    pairs = labelled_pairs(small, cfg)
    table = pairs.toPandas()
    x, y = table[list(FEATURES)].to_numpy(float), table["y"].to_numpy()
    low, high = (f(table["fold_a"], table["fold_b"]) for f in (np.minimum, np.maximum))
    p = np.zeros(len(table))
    for i, j in {*zip(low, high)}:
        held = (low == i) & (high == j)
        known = ~table["fold_a"].isin([i, j]) & ~table["fold_b"].isin([i, j])
        assert not set(table["fold_a"][known]) & {i, j}  # no operator of a judged pair was trained on
        if known.any():
            p[held] = plain_model(x[known], y[known], cfg)(x[held])
    judged = cross_validate(pairs, 3, cfg).filter("kind = 'pair'").toPandas().merge(table.assign(want=p)[["a", "b", "want"]], on=["a", "b"])
    assert len(judged) == len(table) and np.allclose(judged["p"], judged["want"], atol=1e-9)
    clusters, row, weights = learned_attribution(small, cfg)
    got = row.first().asDict()
    assert got["defined"] and got["folds_used"] == 3 and got["pairs"] == len(table) and got["positives"] == y.sum()
    assert abs(got["auc"] - plain_auc(p.round(15), y)) < 1e-6 and {r["feature"] for r in weights.collect()} == set(FEATURES)
    of = {r["account"]: r["cluster_id"] for r in clusters.collect()}
    owner = {a: o for a, o in small.filter("operator is not null").groupBy("source").agg(F.max_by("operator", "pos")).collect()}
    owned = sorted(owner)
    both = [(of[a] == of[b], owner[a] == owner[b]) for i, a in enumerate(owned) for b in owned[:i]]
    hit, said, true = sum(a and b for a, b in both), sum(a for a, _ in both), sum(b for _, b in both)
    assert got["linkage_recall"] == pytest.approx(hit / true) and got["attribution_precision"] == pytest.approx(hit / said if said else 0)


def test_too_few_operators_are_not_scored_as_learned(spark):
    few = ledger(spark, (1, 1, 10, "a", "x", 5, 1), (2, 2, 11, "b", "x", 5, 2))
    clusters, row, weights = learned_attribution(few, LearnConfig())
    got = row.first()
    assert not got["defined"] and np.isnan(got["auc"]) and got["num_clusters"] == clusters.count()
    assert all(r["weight"] is None for r in weights.collect())


@pytest.mark.parametrize("policy", ["operator_hub", "dedicated", "shared_relayers"])
def test_funding(spark, policy):
    base = ledger(spark, (1, 1, 100, "a", "x", 5, 1), (2, 2, 200, "b", "x", 5, 2), (3, 3, 300, "a", "y", 5, 1), (4, 4, 400, "c", "a", 5, None, "p204"), (5, 5, 500, "b", "z", 5, 2, "a"))
    cfg = FundingConfig(policy, relayers=2, lead_min_secs=150, lead_max_secs=900)
    done = apply_funding(base, cfg, seed=3)
    assert done.filter("pos <= 4").exceptAll(base).count() == 0
    added = [r for r in done.collect() if r["sig"] > 5]
    first = {"p201": (100, 1), "p202": (200, 2), "p203": (300, 1)}  # p204 pays for nobody known, a acts itself
    assert {r["dest"] for r in added} == set(first) and sorted(r["slot"] for r in added) == [6, 7, 8]
    assert [r["ts"] for r in sorted(added, key=lambda r: r["sig"])] == sorted(r["ts"] for r in added)
    for r in added:
        ts, operator = first[r["dest"]]
        assert 150 <= ts - r["ts"] <= 900 and r["fee_payer"] == r["source"]  # some lie before the ledger's start
        assert r["operator"] == (None if policy == "shared_relayers" else operator)
        if policy == "operator_hub":
            assert r["source"] == {1: "a", 2: "b"}[operator]
    if policy == "dedicated":
        assert len({r["source"] for r in added}) == 2


def test_hub_of_generated_agents_is_their_first_account(spark):
    cfg = GenConfig(agents=3, days=1, funding=FundingConfig("operator_hub"))
    made = generate(spark, presets(), cfg)
    base = generate(spark, presets(), replace(cfg, funding=FundingConfig()))
    added = made.join(base.select("sig"), "sig", "left_anti").select("operator", "source").distinct().collect()
    assert {(r["operator"], r["source"]) for r in added} == {(i, account(cfg.seed, "sub", i, 0)) for i in range(3)}


def test_names_of_modes_are_not_case_sensitive(spark):
    plain = GenConfig(agents=2, days=1, hardening=Hardening(maintenance=0.5, rebalance="rotate"))
    loud = replace(plain, mode="Cooker", hardening=replace(plain.hardening, rebalance="ROTATE"))
    a, b = (generate(spark, presets(), c) for c in (plain, loud))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    with pytest.raises(ValueError):
        replace(plain, mode="other").validate()


def test_comparison_and_reports(spark, tmp_path):
    naive, hard = run_comparison(spark, presets(), GenConfig(agents=6, days=2))
    reports = {"naive": written(report(written(naive, "naive")), "report"), "hardened": written(report(written(hard, "hard")), "report")}
    said = verdict(reports["naive"], reports["hardened"]).first()
    n, h = (r.first() for r in reports.values())
    assert h["attribution_f1"] < n["attribution_f1"] and said["f1_drop_percent"] == pytest.approx((1 - h["attribution_f1"] / n["attribution_f1"]) * 100)
    assert json.loads(report_document(reports["naive"]).first()[0])["num_accounts"] == n["num_accounts"]
    write_report(reports["naive"], f"file://{tmp_path}/out")
    assert json.loads(spark.read.text(f"file://{tmp_path}/out").first()[0])["num_clusters"] == n["num_clusters"]
    lines = [r["line"] for r in text_table(reports).orderBy("n").collect()]
    assert lines[0].split() == ["naive", "hardened"] and lines[1].split() == ["num_accounts", str(n["num_accounts"]), str(h["num_accounts"])]
    assert len(lines) == 1 + len(reports["naive"].columns) and len({len(x) for x in lines}) == 1


def test_pairs_are_made_in_their_cells_and_never_move(spark, small):
    made = pair_features(public(small), ownership(small), LearnConfig())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split()[0] == "MapInArrow"  # neither a join nor an exchange above the pairs
    items = {c: {} for c in ("fee_payer", "dest")}
    for r in small.collect():
        for c, of in items.items():
            of.setdefault(r["source"], set()).add(r[c])
    owned = sorted(r["account"] for r in ownership(small).collect())
    found = {(r["a"], r["b"]): r for r in made.collect()}
    assert sorted(found) == [(a, b) for a, b in product(owned, owned) if a < b]
    for (a, b), r in found.items():
        for c, of in items.items():
            both = len((of[a] & of[b]) - {None})
            assert r[f"{c}_jaccard"] == (both / (len(of[a]) + len(of[b]) - both) if both else 0)


def test_blocks_are_read_by_their_cells_and_not_sent_to_each(spark, small, monkeypatch):
    """Every row of an account was sent to as many cells as there are blocks."""
    made = lambda: pair_features(public(small), ownership(small), LearnConfig())
    want = sorted(map(tuple, made().collect()))
    monkeypatch.setattr(features, "LEAST_BLOCKS", 3)
    few = made()
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, few.collect())) == want


def test_pairs_get_their_labels_without_moving(spark, small, monkeypatch):
    monkeypatch.setattr(learned, "written", lambda df, label: df)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for accounts too many for it
        plan = labelled_pairs(small, LearnConfig())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    above = plan.split("MapInArrow")[0]
    assert "BroadcastHashJoin" in above and "SortMergeJoin" not in above


def test_weights_without_a_table_of_the_pairs(spark, small):
    """The pairs were written once and sent to each fold set."""
    with scratch_scope() as paths:
        queries()["learned_weights"](spark, "/root/testdata/sf0.001").collect()
    assert paths and not [p for p in paths if p.rsplit("/", 1)[1].split("-")[0] in ("pairs", "judged")]
    for cfg in (LearnConfig(folds=3, iterations=60), LearnConfig(folds=1), LearnConfig(min_positives=10**9)):
        want = {r["feature"]: r for r in learned_attribution(small, cfg)[2].collect()}
        got = {r["feature"]: r for r in learned_weights(small, cfg).collect()}
        assert got.keys() == want.keys()
        for f, r in got.items():
            assert (r["weight"] is None) == (want[f]["weight"] is None) and r["auc"] == pytest.approx(want[f]["auc"], abs=1e-12)
            assert r["weight"] is None or r["weight"] == pytest.approx(want[f]["weight"], abs=1e-9)
    alone = ledger(spark, (1, 1, 10, "a", "x", 5, 1))
    assert learned_weights(alone).count() == 0 == learned_attribution(alone)[2].count()


def many_rows(n, ratios):
    rng = np.random.default_rng(5)
    few = [np.zeros(n) for _ in FEATURES[:-1]]
    few[1], few[2] = rng.integers(0, 3, n) / 3, np.log1p(rng.integers(0, 2, n))
    return Rows(few, rng.integers(0, 2, n), ratios(rng, n), np.ones(n))


def test_condensed_rows_have_the_sums_of_all(spark):
    rows = many_rows(40_000, lambda rng, n: np.where(rng.random(n) < 0.3, 0.0, rng.random(n)))
    bins = bins_for(0)
    once = condense(rows, bins)
    parts = [condense(rows.take(np.arange(i, 40_000, 7)), bins) for i in range(7)]
    for got in (once, condense(condensed.joined(parts), bins)):
        assert len(got.n) <= 12 * bins * condensed.NODES
        for group in range(3):
            for f in (lambda t: t**0, lambda t: t**7, lambda t: 1 / (1 + np.exp(4 - 12 * t))):
                a, b = (r.n[m] @ f(r.ratio[m]) for r in (rows, got) for m in [np.isclose(r.few[1], group / 3) & (r.label == 1)])
                assert a == pytest.approx(b, rel=1e-9)
    assert bins_for(12) == 16 and bins_for(13) == 32


@pytest.mark.parametrize("ratios", [lambda rng, n: rng.random(n) ** 2, lambda rng, n: np.full(n, 0.7)])
def test_model_of_condensed_rows_is_that_of_all(ratios):
    rows, cfg = many_rows(30_000, ratios), LearnConfig()
    rows = rows._replace(label=((rows.few[1] + rows.ratio + np.sin(np.arange(30_000.0))) > 1.2).astype(int))
    whole = Logistic(cfg).fit(np.stack([*rows.few, rows.ratio], axis=1), rows.label.astype(float))
    model = Logistic(cfg).fit_condensed(condense(rows, bins_for(0)))
    assert bins_for(model.steepest) == bins_for(0)
    assert np.allclose(model.w, whole.w, atol=1e-9) and model.bias == pytest.approx(whole.bias, abs=1e-9)
    assert np.allclose(model.std, whole.std, atol=1e-9)


def test_too_steep_a_model_gets_narrower_bins(spark, small, monkeypatch):
    cfg, made = LearnConfig(folds=2, iterations=20), []
    once = learned.condensed_pairs
    monkeypatch.setattr(learned, "bins_for", lambda steepest: 64 if steepest else 16)
    monkeypatch.setattr(learned, "condensed_pairs", lambda blocks, k, bins: made.append(bins) or once(blocks, k, bins))
    got = {r["feature"]: r["weight"] for r in learned_weights(small, cfg).collect()}
    want = {r["feature"]: r["weight"] for r in learned_attribution(small, cfg)[2].collect()}
    assert made == [16, 64] and got == pytest.approx(want, abs=1e-9)


def test_ratio_auc_is_exact_with_ties_and_without_times(spark, monkeypatch):
    rng = np.random.default_rng(2)
    start = rng.integers(0, 60, 150)
    spans = [(int(r), int(a), int(a + d)) for r, a, d in zip(rng.integers(0, 4, 150), start, rng.integers(0, 50, 150))]
    spans += [(1, None, None), (1, None, None), (2, None, None), (3, 5, 5), (3, 5, 5)]
    nan = np.nan
    rows = []
    for i, (r, a, b) in enumerate(spans):
        for s, c, d in spans[:i]:
            ends = [nan if x is None else float(x) for x in (a, b, c, d)]
            over, within = np.fmin(ends[1], ends[3]) - np.fmax(ends[0], ends[2]), np.fmax(ends[1], ends[3]) - np.fmin(ends[0], ends[2])
            rows.append((float(np.fmax(over, 0) / np.fmax(within, 1)), int(r == s)))
    want = roc_auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["auc"]
    table = spark.createDataFrame(spans, "rank long, t0 long, t1 long")
    positives = sum(y for _, y in rows)
    for pairs_of_range, pairs_of_stripe in ((1 << 22, 1 << 25), (700, 900)):
        monkeypatch.setattr(condensed, "RANGE", pairs_of_range)
        monkeypatch.setattr(condensed, "STRIPE", pairs_of_stripe)
        assert ratio_auc(table, len(rows), positives) == pytest.approx(want, abs=1e-14)
    assert ratio_auc(table, len(rows), 0) is None

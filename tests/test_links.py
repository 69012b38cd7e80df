from dataclasses import replace

import pytest
from ledgers import ledger, same

from ledgerloom.config import LearnConfig, LinkConfig
from ledgerloom.operators.accounts import ownership, public
from ledgerloom.operators.clusters import cluster
from ledgerloom.operators.components import connected_components
from ledgerloom.operators.features import FEATURES, pair_features
from ledgerloom.operators.groups import burst_groups, window_groups
from ledgerloom.operators.learned import roc_auc
from ledgerloom.operators.metrics import evaluate

OFF = LinkConfig.nothing()
COPAY = replace(OFF, use_burst_copay=True)
PEEL = replace(OFF, use_temporal_amount=True)


def groups(df):
    return df.select("group_id").distinct().count()


def test_copay_needs_two_buckets(spark):
    rows = [(1, 1, 100, "1", "10", 10**6), (2, 2, 100, "2", "10", 10**6), (3, 3, 200, "1", "10", 10**6), (4, 4, 200, "2", "10", 10**6)]
    assert same(cluster(ledger(spark, *rows), COPAY), "1", "2")
    assert not same(cluster(ledger(spark, *rows[:2]), COPAY), "1", "2")


def test_copay_amount_floor_and_size_cap(spark):
    rows = [(3 * t + i, 3 * t + i, 100 * (t + 1), str(i), "10", 5_000 if i == 3 else 10**6) for t in range(2) for i in (1, 2, 3)]
    found = cluster(ledger(spark, *rows), replace(COPAY, copay_min_amount=10_000))
    assert same(found, "1", "2") and not same(found, "1", "3")
    crowd = [(20 * t + i, 20 * t + i, 100 * (t + 1), f"s{i}", "50", 10**6) for t in range(2) for i in range(11)]
    assert not same(cluster(ledger(spark, *crowd), COPAY), "s0", "s1")


def test_cospend_needs_an_active_hub(spark):
    rows = [(1, 1, 10, "1", "9", 5), (2, 2, 20, "2", "9", 5), (3, 3, 30, "9", "a", 5)]
    cfg = replace(OFF, use_cospend=True)
    assert same(cluster(ledger(spark, *rows), cfg), "1", "2", "9")
    assert not same(cluster(ledger(spark, *rows[:2]), cfg), "1", "2")


@pytest.mark.parametrize("first, linked", [(200, True), (600, True), (601, False), (99, False)])
def test_activation_window(spark, first, linked):
    rows = ledger(spark, (1, 1, 100, "1", "2", 5), (2, 2, first, "2", "3", 0))
    cfg = replace(OFF, use_activation_lineage=True, activation_window_secs=500)
    assert same(cluster(rows, cfg), "1", "2") == linked


@pytest.mark.parametrize("gap, off, linked", [(0, 0, True), (120, 0, True), (121, 0, False), (10, 5_000, True), (10, 5_001, False)])
def test_peel_boundaries(spark, gap, off, linked):
    rows = ledger(spark, (1, 1, 100, "1", "9", 10**6), (2, 2, 100 + gap, "9", "2", 10**6 - off))
    assert same(cluster(rows, PEEL), "1", "2") == linked


def test_coactivity_needs_three_bursts(spark):
    rows = [(2 * t + i, 2 * t + i, 100 * t, str(i), f"d{i}", 1) for t in range(1, 4) for i in (0, 1)]
    cfg = replace(OFF, use_burst_coactivity=True)
    assert same(cluster(ledger(spark, *rows), cfg), "0", "1")
    assert not same(cluster(ledger(spark, *rows[:4]), cfg), "0", "1")
    ceiling = replace(OFF, use_burst_union_ceiling=True)
    assert same(cluster(ledger(spark, *rows[:2]), ceiling), "0", "1")


@pytest.mark.parametrize("payers, linked", [(3, True), (2, False)])
def test_funder(spark, payers, linked):
    rows = [(i, i, i, "f", f"p{i}", 5, None, "f") for i in range(payers)]
    rows += [(10 + i, 10 + i, 50 + i, f"s{i % 2}", "z", 5, None, f"p{i}") for i in range(payers)]
    cfg = replace(OFF, use_funder_graph=True)
    assert same(cluster(ledger(spark, *rows), cfg), "s0", "s1") == linked


def test_bursts_and_windows(spark):
    at = lambda *x: public(ledger(spark, *((i, s, t, "a", "b", 1) for i, (s, t) in enumerate(x))))
    assert groups(burst_groups(at((1, 10), (2, 10), (3, 11), (4, 11)))) == 2
    assert groups(burst_groups(at((1, 10), (5, 10)))) == 2
    three = at((1, 100), (2, 150), (3, 200))
    assert groups(window_groups(three, 120)) == 1 and groups(window_groups(three, 40)) == 3
    assert groups(window_groups(at((1, 100), (2, 100), (3, 200), (4, 200)), 0)) == 2
    days = at((1, 86_390), (2, 86_410), (3, 172_795), (4, 172_805))
    assert groups(window_groups(days, 30)) == 2


def test_scores(spark):
    rows = ledger(spark, (1, 1, 10, "A", "x", 1, 0, "p"), (2, 2, 10, "B", "x", 1, 0, "p"), (3, 3, 10, "C", "x", 1, 1, "p"))
    r = evaluate(rows, cluster(rows, replace(OFF, use_fee_payer=True)), 0).first()
    assert abs(r["attribution_precision"] - 1 / 3) < 1e-9 and r["linkage_recall"] == 1.0 and r["largest_cluster_frac"] == 1.0
    assert abs(r["burst_purity"] - 1 / 3) < 1e-9
    bare = ledger(spark, (1, 1, 10, "A", "x", 1))
    r = evaluate(bare, cluster(bare, OFF), 0).first()
    assert (r["attribution_f1"], r["fragmentation"], r["burst_purity"], r["owned_accounts"]) == (0.0, 1.0, 1.0, 0)


def test_funder_anonymity(spark):
    rows = ledger(
        spark, (1, 1, 1, "f", "p1", 5, None, "f"), (2, 2, 2, "f", "p2", 5, None, "f"), (3, 3, 3, "a", "x", 1, 0, "p1"), (4, 4, 4, "b", "x", 1, 1, "p2")
    )
    r = evaluate(rows, cluster(rows, OFF), 0).first()
    assert (r["funding_records"], r["funder_anonymity_set"]) == (2, 2.0)


def test_last_label_owns(spark):
    rows = ledger(spark, (1, 1, 1, "a", "x", 1, 7), (2, 2, 2, "a", "x", 1, 3), (3, 3, 3, "a", "x", 1))
    assert ownership(rows).first()["operator"] == 3


def test_labels_do_not_reach_features(spark):
    rows = [(i, i, 10 * (i // 2), f"s{i % 4}", f"d{i % 3}", 5, i % 4 % 2, f"p{i % 5}") for i in range(24)]
    swapped = [(*r[:6], 1 - r[6], r[7]) for r in rows]
    a, b = (ledger(spark, *x) for x in (rows, swapped))
    f = lambda x: sorted(map(tuple, pair_features(public(x), ownership(x), LearnConfig()).collect()))
    assert f(a) == f(b) and len(f(a)) == 6 and len(FEATURES) == 8


def test_auc(spark):
    auc = lambda *x: roc_auc(spark.createDataFrame(list(x), "s double, y int"), "s", "y").first()["auc"]
    assert auc((0.1, 0), (0.9, 1)) == 1.0 and auc((0.9, 0), (0.1, 1)) == 0.0
    assert auc((0.5, 0), (0.5, 1)) == 0.5 and auc((0.5, 1)) is None


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x", "x"), ("y", "z")], "a string, b string")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {f"{i:03}": "000" for i in range(61)} | {"y": "y", "z": "y"}
    assert connected_components(edges.limit(0)).count() == 0


def test_components_of_hubs(spark):
    """Nodes that hold most edges, as the smallest and as the largest of their component."""
    pairs = [(x, 2999) for x in range(0, 3000, 2)] + [(5, x) for x in range(1, 900, 2)] + [(x, x + 2) for x in range(1001, 1400, 2)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    found = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {x: top(x) for x in root}

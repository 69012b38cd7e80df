"""The learned linker: operator-disjoint cross-validation of a logistic regression over pair features."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import LearnConfig
from ..storage import written
from .accounts import accounts, ownership, public
from .clusters import close
from .condensed import RATIO, Rows, bins_for, codes, condensed_pairs, for_each, gathered, ratio_auc, score_counts
from .features import FEATURES, account_blocks, pair_features
from .metrics import evaluate


#: So many accounts or fewer are sent to every worker.
SENT_TO_ALL = 1_000_000
#: Rows whose errors are worked out at once, so that they stay near the processor.
ROWS_AT_ONCE = 1 << 14


def roc_auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties at half; NULL where one class is missing.

    Rows are first counted per distinct score, so the ordered window sees
    distinct scores only.
    """
    by = by or []
    counts = df.groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"), F.count(F.lit(1)).alias("_n")
    )
    return _auc(counts, score, by)


def _auc(counts: DataFrame, score: str, by: list[str]) -> DataFrame:
    """From rows with the numbers of positive pairs and of all pairs with a score."""
    below = F.coalesce(
        F.sum(F.col("_n") - F.col("_pos")).over(
            W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    won = counts.withColumn("_won", F.col("_pos") * (below + (F.col("_n") - F.col("_pos")) / 2.0))
    pos, neg = F.sum("_pos"), F.sum(F.col("_n") - F.col("_pos"))
    auc = F.when((pos > 0) & (neg > 0), F.sum("_won") / (pos.cast("double") * neg))
    grouped = won.groupBy(*by) if by else won.groupBy()
    return grouped.agg(auc.alias("auc"))


class Logistic:
    """Class-weighted logistic regression: fixed steps of full-batch descent on standardised features."""

    def __init__(self, cfg: LearnConfig):
        self.cfg = cfg

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, std = x.mean(axis=0), x.std(axis=0)
        self.std = np.where(std < 1e-9, 1.0, std)
        z = (x - self.mean) / self.std
        pos, neg = max(float(y.sum()), 1.0), max(float(len(y) - y.sum()), 1.0)
        weight = np.where(y > 0.5, neg / pos, 1.0)
        self.w, self.bias = np.zeros(x.shape[1]), 0.0
        step = self.cfg.learning_rate / weight.sum()
        for _ in range(self.cfg.iterations):
            error = weight * (self._sigmoid(z @ self.w + self.bias) - y)
            self.w = self.w - step * (z.T @ error + self.cfg.l2 * self.w)
            self.bias -= step * error.sum()
        return self

    def fit_condensed(self, rows: Rows) -> Logistic:
        """The same over rows that stand for n pairs each, with y as the label; keeps the steepest slope along the ratio."""
        code = codes(rows.few, np.zeros(len(rows.n), np.int64))
        order = np.argsort(code)
        begin = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
        few = np.stack([c[order[begin]] for c in rows.few], axis=1)
        at = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
        ratio, n, y, total = rows.ratio[order], rows.n[order], rows.label[order], rows.n.sum()
        of_few = np.add.reduceat(n, begin)
        self.mean = np.r_[of_few @ few, n @ ratio] / total
        var = np.r_[of_few @ (few - self.mean[:-1]) ** 2, n @ (ratio - self.mean[-1]) ** 2] / total
        std = np.sqrt(np.maximum(var, 0))
        self.std = np.where(std < 1e-9, 1.0, std)
        many = round(n @ y)
        pos, neg = max(float(many), 1.0), max(float(round(total) - many), 1.0)
        weight = n * np.where(y > 0.5, neg / pos, 1.0)
        self.w, self.bias, self.steepest = np.zeros(len(FEATURES)), 0.0, 0.0
        step = self.cfg.learning_rate / weight.sum()
        error = np.empty(len(n))
        for _ in range(self.cfg.iterations):
            slope = self.w / self.std
            self.steepest = max(self.steepest, abs(slope[-1]))
            start = few @ slope[:-1] + (self.bias - slope @ self.mean)
            for low in range(0, len(n), ROWS_AT_ONCE):
                part = slice(low, low + ROWS_AT_ONCE)
                error[part] = weight[part] * (self._sigmoid(start[at[part]] + slope[-1] * ratio[part]) - y[part])
            by_few = np.add.reduceat(error, begin)
            sums = np.r_[by_few @ few, error @ ratio] - self.mean * by_few.sum()
            self.w = self.w - step * (sums / self.std + self.cfg.l2 * self.w)
            self.bias -= step * by_few.sum()
        return self

    @staticmethod
    def _sigmoid(t: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(t, -700, 700)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(((x - self.mean) / self.std) @ self.w + self.bias)


def folds_of(owned: DataFrame, k: int) -> DataFrame:
    """Operators dealt to folds by rank. The operator table is ordered as a whole; it has one row an operator."""
    rank = F.dense_rank().over(W.orderBy("operator")) - 1
    return owned.select("operator").distinct().withColumn("rank", rank).withColumn("fold", (F.col("rank") % k).cast("int"))


def _dealt(owned: DataFrame, n_ops: int, k: int) -> DataFrame:
    folds = folds_of(owned, k)
    return owned.join(F.broadcast(folds) if n_ops < 100_000 else folds, "operator")


def labelled_pairs(labelled: DataFrame, cfg: LearnConfig) -> DataFrame:
    """Features, labels and folds of all owned pairs, written once as every later step reads it."""
    owned = ownership(labelled)
    n_ops = owned.select("operator").distinct().count()
    k = max(1, min(cfg.folds, n_ops))
    dealt = _dealt(owned, n_ops, k)
    side = lambda x: dealt.select(
        F.col("account").alias(x), F.col("operator").alias(f"op_{x}"), F.col("fold").alias(f"fold_{x}")
    )
    # the pairs are quadratic in the accounts and must not move to meet them
    sent = F.broadcast if owned.count() <= SENT_TO_ALL else lambda x: x
    pairs = pair_features(public(labelled), owned, cfg).join(sent(side("a")), "a").join(sent(side("b")), "b")
    same = (F.col("op_a") == F.col("op_b")).cast("int").alias("y")
    return written(pairs.select("a", "b", *FEATURES, same, "fold_a", "fold_b"), "pairs")


def cross_validate(pairs: DataFrame, k: int, cfg: LearnConfig) -> DataFrame:
    """Held-out probability of every pair, and a row of weights per model (kind ``model``).

    The model of the fold set {i, j} is trained on the pairs with no end in i
    or j and judges the pairs with just these folds. A model needs its rows in
    one worker; there are at most k (k + 1) / 2 of them.
    """
    sets = pairs.sparkSession.createDataFrame(
        [(i, j) for i, j in combinations_with_replacement(range(k), 2)], "fi int, fj int"
    )
    a, b, i, j = (F.col(c) for c in ("fold_a", "fold_b", "fi", "fj"))
    test = (F.least(a, b) == i) & (F.greatest(a, b) == j)
    train = ~a.isin(i, j) & ~b.isin(i, j)
    rows = pairs.join(F.broadcast(sets), test | train).withColumn("held", test)
    names = list(FEATURES)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf["held"].to_numpy(bool)
        out = pdf.loc[held, ["a", "b", "y"]].assign(kind="pair", p=0.0, trained=0, weights=None)
        if held.all() or not held.any():
            return out
        known = pdf.loc[~held].sort_values(["a", "b"])
        model = Logistic(cfg).fit(known[names].to_numpy(float), known["y"].to_numpy(float))
        out["p"] = model.predict(pdf.loc[held, names].to_numpy(float))
        about = pd.DataFrame(
            {"a": [None], "b": [None], "y": [0], "kind": ["model"], "p": [0.0], "trained": [len(known)], "weights": [list(map(float, model.w))]}
        )
        return pd.concat([out, about], ignore_index=True)

    schema = "a string, b string, y int, kind string, p double, trained long, weights array<double>"
    return rows.groupBy("fi", "fj").applyInPandas(run, schema)


def learned_weights(labelled: DataFrame, cfg: LearnConfig | None = None) -> DataFrame:
    """(feature, weight, auc), as the last of :func:`learned_attribution`, without a table of the pairs.

    The models are fitted to condensed rows, which are shuffled once; every
    model reads the table of them as it is. It is made again with narrower
    bins if a model turns out too steep for them.
    """
    cfg = cfg or LearnConfig()
    spark = labelled.sparkSession
    owned = ownership(labelled)
    n_ops = owned.select("operator").distinct().count()
    k = max(1, min(cfg.folds, n_ops))
    dealt = written(_dealt(owned, n_ops, k).select("account", "rank"), "owned")
    per = dealt.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    n, positives = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.expr("sum(n * (n - 1) div 2)"), F.lit(0))).first()
    n = n * (n - 1) // 2
    if not n:
        return spark.createDataFrame([], "feature string, weight double, auc double")
    blocks, bins = account_blocks(public(labelled), dealt, cfg), bins_for(0)
    condensed = condensed_pairs(blocks, k, bins)
    defined = n_ops >= cfg.min_operators and positives >= cfg.min_positives and k >= 2
    while defined:
        models = written(_models(condensed, k, bins, cfg), "models")
        needed = bins_for(models.agg(F.coalesce(F.max("steepest"), F.lit(0.0))).first()[0])
        if needed <= bins:
            break
        bins = needed
        condensed = condensed_pairs(blocks, k, bins)
    times = public(labelled).select(F.col("source").alias("account"), F.col("ts").cast("long").alias("ts")).join(dealt, "account")
    spans = times.groupBy("account", "rank").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")).select("rank", "t0", "t1")
    of_ratio = spark.createDataFrame([(RATIO, ratio_auc(spans, n, positives))], "feature string, auc double")
    single = _auc(score_counts(condensed, k), "score", ["feature"]).unionByName(of_ratio)
    if not defined:
        return single.select("feature", F.lit(None).cast("double").alias("weight"), "auc")
    return _mean_weights(models).join(single, "feature", "right").select("feature", "weight", "auc")


def _models(condensed: DataFrame, k: int, bins: int, cfg: LearnConfig) -> DataFrame:
    """(trained, weights, steepest) of each fold set that has pairs to train on and to judge, as in :func:`cross_validate`."""
    sets = list(combinations_with_replacement(range(k), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = False

        def known() -> Iterator[Rows]:
            nonlocal judged
            for batch in batches:
                for number, data in zip(batch.column("id").to_pylist(), batch.column("data")):
                    i, j = sets[number]
                    rows = Rows.of(data)
                    y, low, high = rows.label // (k * k), rows.label // k % k, rows.label % k
                    judged = judged or bool(((low == i) & (high == j)).any())
                    yield rows._replace(label=y).take(np.flatnonzero((low != i) & (low != j) & (high != i) & (high != j)))

        for rows in gathered(known(), bins):
            if judged and len(rows.n):
                model = Logistic(cfg).fit_condensed(rows)
                about = [[round(rows.n.sum())], [list(map(float, model.w))], [float(model.steepest)]]
                yield pa.RecordBatch.from_arrays([pa.array(about[0], pa.int64()), pa.array(about[1]), pa.array(about[2])], ["trained", "weights", "steepest"])

    return for_each(len(sets), condensed, run, "trained long, weights array<double>, steepest double")


def _mean_weights(models: DataFrame) -> DataFrame:
    """(feature, weight): of all models, by the pairs each was trained on."""
    return (
        models.select("trained", F.posexplode("weights").alias("at", "w"))
        .groupBy("at")
        .agg((F.sum(F.col("w") * F.col("trained")) / F.sum("trained")).alias("weight"))
        .select(F.element_at(F.array(*map(F.lit, FEATURES)), F.col("at") + 1).alias("feature"), "weight")
    )


def learned_attribution(labelled: DataFrame, cfg: LearnConfig | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, one-row report, (feature, weight, auc)).

    The report holds the AUC, the folds and the scores of the clusters, as the
    rules' clusters are scored. With too few operators or positive pairs no
    model is fitted: the AUC is NaN, nothing is linked and the weights are NULL.
    """
    cfg = cfg or LearnConfig()
    spark = labelled.sparkSession
    pairs = labelled_pairs(labelled, cfg)
    n_ops = ownership(labelled).select("operator").distinct().count()
    n, positives = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    k = max(1, min(cfg.folds, n_ops))
    defined = n_ops >= cfg.min_operators and positives >= cfg.min_positives and k >= 2
    single = roc_auc(
        pairs.select("y", F.expr(f"stack({len(FEATURES)}, {', '.join(f'{f!r}, {f}' for f in FEATURES)}) as (feature, score)")),
        "score",
        "y",
        ["feature"],
    )
    nodes = accounts(labelled)
    if not defined:
        clusters = close(None, nodes)
        report = spark.createDataFrame(
            [(n_ops, n, int(positives), False, math.nan, k)],
            "operators long, pairs long, positives long, defined boolean, auc double, folds_used int",
        )
        weights = single.select("feature", F.lit(None).cast("double").alias("weight"), "auc")
        return clusters.select("account", "cluster_id"), _scored(report, labelled, clusters, cfg), weights
    judged = written(cross_validate(pairs, k, cfg), "judged")
    held = judged.filter("kind = 'pair'")
    # fold sets without training rows keep a probability of zero
    report = roc_auc(held, "p", "y").select(
        F.lit(n_ops).cast("long").alias("operators"),
        F.lit(n).cast("long").alias("pairs"),
        F.lit(int(positives)).cast("long").alias("positives"),
        F.lit(True).alias("defined"),
        F.coalesce("auc", F.lit(math.nan)).alias("auc"),
        F.lit(k).alias("folds_used"),
    )
    linked = held.filter(F.round("p", 6) >= cfg.threshold).select("a", "b")
    models = judged.filter("kind = 'model'")
    weights = _mean_weights(models).join(single, "feature", "right")
    clusters = close(linked, nodes).select("account", "cluster_id")
    return clusters, _scored(report, labelled, clusters, cfg), weights.select("feature", "weight", "auc")


def _scored(report: DataFrame, labelled: DataFrame, clusters: DataFrame, cfg: LearnConfig) -> DataFrame:
    return report.join(F.broadcast(evaluate(labelled, clusters.select("account", "cluster_id"), cfg.copay_window_secs)))

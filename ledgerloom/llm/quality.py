"""Quality rules: base rules on word statistics, then robust multivariate outliers.

The statistics of the documents that pass the base rules, transformed, get a
minimum-covariance-determinant estimate for each language and source: from
several fixed starts, concentration steps repeat "take the three quarters
nearest by Mahalanobis distance, estimate again" for as long as the
determinant falls, and of all starts the least determinant wins. A document
too far from its group's estimate is rejected.

All of it is SQL functions. Statistics are computed inside a row, by array
functions; estimates come from integer sums per group and distance bin, so
they do not depend on the order of rows. Rows meet the estimates of their group
by a salted key, so a source with a third of all rows is spread out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import discard, written
from .rows import unwrapped, wrapped
from .words import GAP, SPACES

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEPT_SHARE = 0.75
#: Determinants fall from step to step, so this bound is never met; it raises.
MOST_STEPS = 500
#: A distance that a chi-squared variable of five degrees exceeds once in a hundred thousand draws.
TAIL = 1e-5
SCALE = 1024
#: Bins per doubling of a distance; the subset ends with a whole bin.
BINS = 256
SALTS = 64
#: All starts take so many steps; then so many of the lowest determinants of a group go on to the end.
SHORT_STEPS, FINALISTS = 2, 3
#: The transformed statistics, each with the least standard deviation that counts. It guards against singular
#: estimates, as most texts repeat nothing: a variance below its square is raised to it, others stay as they are.
FEATURES = {"f_words": 1.0, "f_length": 0.1, "f_symbols": 0.5, "f_lines": 0.6, "f_repeats": 0.6}
#: The share of its variance that the other features must leave a feature unexplained, else it counts as so much.
PIVOT = 1e-6
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows that are found twice or more: windows that share a hash, then by their words."""

    def covered(places: Column) -> Column:
        steps = F.aggregate(
            F.sequence(F.lit(1), F.size(places) - 1),
            F.lit(0),
            lambda total, j: total + F.least(F.lit(3), F.get(places, j) - F.get(places, j - 1)),
        )
        return F.when(F.size(places) == 0, 0).when(F.size(places) == 1, 3).otherwise(steps + 3)

    def paired(s: Column, field: str) -> Column:
        """The entries of a sorted array that are equal to a neighbour in this field."""
        at = lambda k: F.get(s, k)[field]
        same = lambda k: F.coalesce(at(k) == at(k - 1), F.lit(False)) | F.coalesce(at(k) == at(k + 1), F.lit(False))
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), same), lambda k: F.get(s, k))

    def twice(s: Column) -> Column:
        gram = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        near = F.sort_array(F.transform(paired(s, "h"), lambda x: F.struct(gram(x["i"]).alias("g"), x["i"].alias("i"))))
        found = _let(near, lambda t: F.when(F.size(t) == 0, F.array().cast("array<int>")).otherwise(F.transform(paired(t, "g"), lambda x: x["i"])))
        return _let(F.sort_array(found), covered)

    def ordered(t: Column) -> Column:
        pairs = F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(_let(F.sort_array(pairs), twice))

    grams = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(grams, ordered))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A NULL or empty text has no words and so fails; a long text is measured
    whole. Rows do not depend on each other, so repeated ones come out alike
    and an empty table gives no rows. Columns of ``docs`` with the names of the
    added ones are replaced, all others stay.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(SPACES))
    found = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))
    counted = _let(found, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    without = lambda chars: F.char_length(t) - F.char_length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    dup = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    measured = F.struct(
        counted.alias("c"),
        (F.char_length(t) - without(SPACES)).cast("long").alias("chars"),
        without(SYMBOLS).cast("long").alias("symbols"),
        dup.cast("long").alias("lines"),
    )
    rows = wrapped(docs, text, without=STATISTICS).withColumn("m", measured)
    n, repeats = F.col("m.c.n").cast("long"), F.col("m.c.r").cast("long")
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    values = (n, F.col("m.chars"), F.col("m.symbols"), F.col("m.lines"), repeats, failed)
    columns = [c for c in docs.columns if c.lower() not in STATISTICS]
    return rows.select(*unwrapped(columns, text), *(v.alias(name) for v, name in zip(values, STATISTICS)))


def _features() -> dict[str, Column]:
    """Transformed statistics in fixed point: sums of integers are the same in any order."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.log1p(100.0 * F.col(c) / n)
    raw = {
        "f_words": F.log1p(F.col("n_words")),
        "f_length": F.log1p(F.col("word_chars") / n),
        "f_symbols": share("n_symbols"),
        "f_lines": share("n_dup_lines"),
        "f_repeats": share("n_repeat_words"),
    }
    return {name: F.round(raw[name] * SCALE).cast("long") for name in FEATURES}


KEY = ["lang_", "source_"]
NAMES = list(FEATURES)
PAIRS = [(f, g) for i, f in enumerate(NAMES) for g in NAMES[: i + 1]]


def _keyed(*more: Column | str) -> list[Column | str]:
    """Group, salt and features of a row; NULL languages and sources are groups of their own."""
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")
    return [group("lang").alias("lang_"), group("source").alias("source_"), salt, *(v.alias(f) for f, v in _features().items()), *more]


def _met(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows beside what is known of their group."""
    return rows.join(params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*KEY, "salt"])


def _starts(rows: DataFrame) -> DataFrame:
    """First distances of each row, one a start, from the medians and quartile spreads of its group.

    Euclidean, greatest and sum of deviations; then, per feature, from its low and from its high end.
    """
    bins = SCALE // 32
    long = rows.select(
        *KEY, F.inline(F.array(*(F.struct(F.lit(f).alias("f"), F.floor(F.col(f) / bins).alias("bin")) for f in NAMES)))
    )
    counts = long.groupBy(*KEY, "f", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy(*KEY, "f").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.partitionBy(*KEY, "f"))
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("bin")))
    found = (
        counts.withColumn("_upto", upto)
        .withColumn("_all", total)
        .groupBy(*KEY, "f")
        .agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    )
    value = lambda f, c: F.max(F.when(F.col("f") == f, c))
    middle = (F.col("q2") + 0.5) * bins
    spread = (F.col("q3") - F.col("q1") + 1) * bins / 1.349
    centre = found.groupBy(*KEY).agg(*(value(f, middle).alias(f"m_{f}") for f in NAMES), *(value(f, spread).alias(f"s_{f}") for f in NAMES))
    z = [(F.col(f) - F.col(f"m_{f}")) / F.greatest(F.col(f"s_{f}"), F.lit(FEATURES[f] * SCALE)) for f in NAMES]
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    upward = lambda x: F.when(x < 0, 1 / (1 - x)).otherwise(1 + x)
    size = [F.abs(x) for x in z]
    first = (total([x * x for x in z]), F.greatest(*size), total(size), *(upward(x) for x in z), *(upward(-x) for x in z))
    return _met(rows, written(centre, "centres")).select(*KEY, *NAMES, F.posexplode(F.array(*first)).alias("start", "d2"))


def _estimated(near: DataFrame) -> DataFrame:
    """Per group and start, mean and covariance of the nearest share of its rows, to the next distance bin."""
    sums = near.groupBy(*KEY, "start", F.floor(BINS * F.log2(1 + F.col("d2"))).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(F.col(f)).alias(f"s_{f}") for f in NAMES),
        *(F.sum(F.col(f) * F.col(g)).alias(f"s_{f}_{g}") for f, g in PAIRS),
    )
    group = W.partitionBy(*KEY, "start")
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = sums.withColumn("_before", before).withColumn("_all", F.sum("n").over(group))
    whole = inner.filter(F.col("_before") < KEPT_SHARE * F.col("_all")).groupBy(*KEY, "start").agg(
        F.sum("n").alias("h"),
        *(F.sum(f"s_{f}").cast("double").alias(f"s_{f}") for f in NAMES),
        *(F.sum(f"s_{f}_{g}").cast("double").alias(f"s_{f}_{g}") for f, g in PAIRS),
    )
    mean = lambda c: F.col(f"s_{c}") / F.col("h")
    return whole.select(
        *KEY,
        "start",
        "h",
        *(mean(f).alias(f"m_{f}") for f in NAMES),
        *((mean(f"{f}_{g}") - mean(f) * mean(g)).alias(f"c_{f}_{g}") for f, g in PAIRS),
    )


def _factored(params: DataFrame, factor: float = 1.0) -> DataFrame:
    """Add the Cholesky factor of ``factor`` times the covariance, guarded, and the logarithm of its determinant."""
    for i, f in enumerate(NAMES):
        own = F.greatest(F.col(f"c_{f}_{f}") * factor, F.lit((FEATURES[f] * SCALE) ** 2))
        for j, g in enumerate(NAMES[: i + 1]):
            value = own if i == j else F.col(f"c_{f}_{g}") * factor
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            value = F.sqrt(F.greatest(value, PIVOT * own)) if i == j else value / F.col(f"l_{j}_{j}")
            params = params.withColumn(f"l_{i}_{j}", value)
    return params.withColumn("log_det", 2 * reduce(lambda a, b: a + b, (F.log(F.col(f"l_{i}_{i}")) for i in range(len(NAMES)))))


def _with_d2(rows: DataFrame) -> DataFrame:
    """Add d2, the squared Mahalanobis distance to the group's estimate, by forward substitution."""
    for i, f in enumerate(NAMES):
        rest = F.col(f) - F.col(f"m_{f}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        rows = rows.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, (F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(NAMES)))))


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function, by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > 1e-16 * total:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < q else (low, middle)
    return low


def consistency(share: float, k: int) -> float:
    """What a covariance of the nearest share of normal data lacks."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


def estimates(rows: DataFrame) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group: (lang_, source_, start, h, m_*, c_*, l_*, log_det).

    ``rows`` is (lang_, source_, salt, features) and is read once a step. A step
    stands where it lowers the determinant, else the one before does; steps
    end when none is lower. Only the number of groups still moving reaches the
    driver.
    """
    spark, names = rows.sparkSession, [*KEY, "start"]
    first = _factored(written(_estimated(_starts(rows)), "moments"))
    values = [c for c in first.columns if c not in names]
    # a start is no estimate itself: ties may make its subset larger than the share
    first = first.withColumn("log_det", F.lit(math.inf)).withColumn("moved", F.lit(True))
    best = written(first, "estimates")

    def lowest(n: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*KEY).orderBy("log_det", "start"))
        return best.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")

    for step in range(MOST_STEPS):
        if step == SHORT_STEPS:
            best = lowest(FINALISTS)
        moving = best.filter("moved")
        if moving.isEmpty():
            return lowest(1).drop("moved")
        known = moving.select(*names, *(c for c in values if c.startswith(("m_", "l_"))))
        near = _with_d2(_met(rows, known)).select(*names, *NAMES, "d2")
        moments = written(_estimated(near), "moments")
        after = _factored(moments).select(*names, F.struct(*values).alias("after"))
        both = best.select(*names, F.struct(*values).alias("before")).join(after, names, "left")
        lower = F.coalesce(F.col("after.log_det") < F.col("before.log_det") - 1e-9, F.lit(False))
        both = both.select(*names, F.when(lower, F.col("after")).otherwise(F.col("before")).alias("now"), lower.alias("moved"))
        last, best = best, written(both.select(*names, "now.*", "moved"), "estimates")
        discard(spark, last)
        discard(spark, moments)
    raise RuntimeError("the estimates still move")


def judged(measured: DataFrame) -> DataFrame:
    """Add ``kept`` to a table that :func:`with_statistics` made and that can be read again cheaply.

    Every group, however small, has its own estimate; the guard of the
    variances alone gives it a least width. NULL languages and sources are
    groups of their own. Ties at the edge of a subset are inside. Repeated
    rows come out alike, an empty table gives no rows; a column called kept is
    replaced and all others stay, whatever their names.
    """
    rows = written(measured.filter("not base_failed").select(*_keyed()), "features")
    found = _factored(written(estimates(rows), "estimate"), consistency(KEPT_SHARE, len(FEATURES)))
    known = found.select(*KEY, *(c for c in found.columns if c.startswith(("m_", "l_"))))
    columns = [c for c in measured.columns if c.lower() != "kept"]
    every = measured.select(*_keyed("base_failed", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")))
    limit = F.lit(chi2_quantile(1 - TAIL, len(FEATURES)))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = ~F.col("base_failed") & (F.col("d2") <= limit)
    rows = _with_d2(every.join(salted, [*KEY, "salt"], "left"))
    return rows.select(*unwrapped(columns), F.coalesce(kept, F.lit(False)).alias("kept"))


def quality_report(docs: DataFrame) -> DataFrame:
    measured = written(with_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "statistics")
    return judged(measured).select("doc_id", *STATISTICS, "kept")

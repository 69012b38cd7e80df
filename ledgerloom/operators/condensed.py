"""The pair table in a form that does not grow with the pairs, for steps that need sums over it or the order of one score.

Nothing here is sampled, capped or left out: a row stands for many pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .features import FEATURES, LABEL, cells, cells_of, packed_table, tiles, unpacked

#: The features with few different values, and the one that is a ratio of times.
FEW, RATIO = FEATURES[:-1], FEATURES[-1]
#: Rows a group of equal features, fold, label and bin of the ratio is put into if it has more.
NODES = 8
#: Rows condensed at once, and rows at which a task passes on what it has.
AT_ONCE, HELD = 1 << 18, 1 << 18
#: Parts that condensed rows are put together in.
PARTS = 48
#: Bins of the ratio for the ranges its pairs are sorted in, pairs of a range, and pairs that a task counts.
PLACES, RANGE, STRIPE = 1 << 16, 1 << 22, 1 << 25

_X = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
#: From sums of Chebyshev polynomials to weights of the nodes.
_SPREAD = np.cos(np.outer(np.arange(NODES), np.arccos(_X))) * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES


class Rows(NamedTuple):
    """Pairs by their features in FEW, a label, and the ratio; n pairs each, not always a whole or positive number."""

    few: list[np.ndarray]
    label: np.ndarray
    ratio: np.ndarray
    n: np.ndarray

    def take(self, at: np.ndarray) -> Rows:
        return Rows([c[at] for c in self.few], self.label[at], self.ratio[at], self.n[at])

    def packed(self) -> bytes:
        return packed_table(pa.table([*self.few, self.label, self.ratio, self.n], names=[*FEW, "label", RATIO, "n"]))

    @staticmethod
    def of(value: pa.Scalar) -> Rows:
        columns = [c.to_numpy() for c in unpacked(value).columns]
        return Rows(columns[: len(FEW)], *columns[len(FEW) :])


def codes(columns: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """A number for each row, equal if all columns are."""
    code, size = first.astype(np.int64), int(first.max(initial=0)) + 1
    for c in columns:
        some = np.flatnonzero(c)
        if len(some):
            values, at = np.unique(c[some], return_inverse=True)
            if size * (len(values) + 1) > 1 << 40:
                known, code = np.unique(code, return_inverse=True)
                size = len(known)
            code = code * (len(values) + 1)
            code[some] += at + 1
            size *= len(values) + 1
    return code


def condense(rows: Rows, bins: int) -> Rows:
    """Groups of over NODES rows, equal but for the ratio and with that in one bin, become NODES rows at Chebyshev's points.

    Their weights are such that the sum of any polynomial in the ratio of a
    degree below NODES stays the same, and so, but for rounding, does that of
    a smooth function (see :func:`bins_for`). A single value stays as it is.
    """
    place = np.minimum((rows.ratio * bins).astype(np.int64), bins - 1)
    code = codes(rows.few, rows.label)
    if code.max(initial=0) >= (1 << 62) // bins:
        code = np.unique(code, return_inverse=True)[1]
    code = code * bins + place
    order = np.argsort(code)
    code, ratio, n = code[order], rows.ratio[order], rows.n[order]
    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
    if len(begin) == len(code):
        return rows
    many = np.diff(np.r_[begin, len(code)])
    one = np.minimum.reduceat(ratio, begin) == np.maximum.reduceat(ratio, begin)
    large = (many > NODES) & ~one
    left = np.repeat(~one & ~large, many)
    at, ratios, ns = [order[left], order[begin[one]]], [ratio[left], ratio[begin[one]]], [n[left], np.add.reduceat(n, begin)[one]]
    if large.any():
        inside, first = np.repeat(large, many), order[begin[large]]
        weight, start = n[inside], np.cumsum(many[large]) - many[large]
        u = 2 * (ratio[inside] * bins - place[order][inside]) - 1
        before, now, sums = np.ones_like(u), u, []
        for _ in range(NODES):
            sums.append(np.add.reduceat(weight * before, start))
            before, now = now, 2 * u * now - before
        at.append(np.repeat(first, NODES))
        ratios.append(((place[first][:, None] + (_X + 1) / 2) / bins).ravel())
        ns.append((np.stack(sums, axis=1) @ _SPREAD).ravel())
    same = rows.take(np.concatenate(at))
    return same._replace(ratio=np.concatenate(ratios), n=np.concatenate(ns))


def bins_for(steepest: float) -> int:
    """Bins in which a sigmoid of a line with this slope is a polynomial of degree NODES - 1 up to 3e-10.

    The sigmoid is analytic up to pi from the real line, so its interpolation
    in a bin of width h is off by about 2 (slope * h / (4 pi)) ** NODES.
    """
    return 1 << min(40, max(4, int(np.ceil(np.log2(max(abs(steepest), 1e-9) / (4 * np.pi * 0.06))))))


def joined(parts: list[Rows]) -> Rows:
    return Rows([np.concatenate(c) for c in zip(*(p.few for p in parts))], *(np.concatenate([p[k] for p in parts]) for k in (1, 2, 3)))


def gathered(parts: Iterator[Rows], bins: int, most: float = np.inf) -> Iterator[Rows]:
    """All rows condensed; as one, or whenever over ``most`` are left."""
    held, size, least = [], 0, 0
    for p in parts:
        held.append(p)
        size += len(p.n)
        if size > 2 * least + AT_ONCE:
            held = [condense(joined(held), bins)]
            size = least = len(held[0].n)
            if size > most:
                yield held[0]
                held, size, least = [], 0, 0
    if held:
        yield condense(joined(held), bins)


def condensed_pairs(blocks: DataFrame, k: int, bins: int) -> DataFrame:
    """(data): all pairs of the blocks as packed :class:`Rows`, written once; label: (y * k + lower fold) * k + higher fold."""

    def pairs(table: pa.Table, alone: bool) -> Iterator[Rows]:
        kind = table.column("kind").to_numpy()
        of = table.filter(pa.array(kind == LABEL))
        order = pc.sort_indices(of.column("source")).to_numpy()
        rank = of.column("w").to_numpy()[order].astype(np.int64)  # by name, as the tiles number them
        for _, x, y, made in tiles(table, alone):
            a, b = rank[x], rank[y]
            low, high = np.minimum(a % k, b % k), np.maximum(a % k, b % k)
            yield Rows(made[:-1], ((a == b) * k + low) * k + high, made[-1], np.ones(len(x)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered((r for cell in cells_of(batches) for r in pairs(*cell)), bins, HELD):
            part = np.zeros(len(rows.n), np.uint64)
            for c in rows.few:
                part = (part ^ (c + 0.0).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                part ^= part >> np.uint64(29)
            part = (part % np.uint64(PARTS)).astype(np.int64)
            for p in np.unique(part):
                yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int64()), pa.array([rows.take(np.flatnonzero(part == p)).packed()], pa.binary())], ["part", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[int, pa.Scalar]]:
            for batch in batches:
                yield from zip(batch.column("part").to_pylist(), batch.column("data"))

        held, now = [], None
        for part, data in [*parts(), (None, None)]:
            if part != now and held:
                for rows in gathered(map(Rows.of, held), bins):
                    yield pa.RecordBatch.from_arrays([pa.array([rows.packed()], pa.binary())], ["data"])
                held = []
            now = part
            held.append(data)

    met = cells(blocks).mapInArrow(count, "part long, data binary").repartition(PARTS, "part").sortWithinPartitions("part")
    return written(met.mapInArrow(merge, "data binary"), "condensed")


def score_counts(condensed: DataFrame, k: int) -> DataFrame:
    """(feature, score, _pos, _n) of the features in FEW."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in map(Rows.of, batch.column("data")):
                for name, c in zip(FEW, rows.few):
                    values, at = np.unique(c, return_inverse=True)
                    pos, n = (np.bincount(at, w, len(values)) for w in (rows.n * (rows.label >= k * k), rows.n))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), *map(pa.array, (values, pos, n))], ["feature", "score", "pos", "n"])

    sums = condensed.mapInArrow(count, "feature string, score double, pos double, n double").groupBy("feature", "score")
    return sums.agg(F.round(F.sum("pos")).cast("long").alias("_pos"), F.round(F.sum("n")).cast("long").alias("_n"))


def for_each(n: int, data: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` once for each number below n, in a task of its own that reads all of ``data``; nothing is shuffled or broadcast."""
    numbers = data.sparkSession.range(0, n, 1, n)
    return numbers.hint("shuffle_replicate_nl").crossJoin(data.coalesce(1)).mapInArrow(run, schema)


class _Spans:
    """First and last times of accounts, those with equal ones and one operator together, by first time."""

    def __init__(self, table: pa.Table):
        rank, t0, t1, n = (table.column(c).to_numpy() for c in ("rank", "t0", "t1", "n"))
        order = np.lexsort((rank, t1, t0))  # without times: last
        self.rank, self.t0, self.t1, self.n = rank[order], t0[order].astype(float), t1[order].astype(float), n[order]
        self.timed = len(rank) - int(np.isnan(self.t0).sum())

    def _row(self, g: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.zeros(1)
        if g < self.timed:
            a, b = self.t0[g], self.t1[g]
            upto = np.searchsorted(self.t0[: self.timed], b - least * (b - a) + 1, side="right")  # later ones share less
            h = slice(g + 1, max(upto, g + 1))
            over, within = np.minimum(self.t1[h], b) - self.t0[h], np.maximum(self.t1[h], b) - a
            own[0] = (b - a) / max(b - a, 1)
        else:  # without times, the other's count
            h = slice(0, self.timed)
            over = within = self.t1[h] - self.t0[h]
        n = int(self.n[g])
        value = np.r_[np.fmax(over, 0) / np.fmax(within, 1), own]
        return value, np.r_[self.n[h] * n, n * (n - 1) // 2], np.r_[self.rank[h] == self.rank[g], True]

    def above_zero(self, rows: range, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(place, ratio, pairs, of one operator) with a place from low to high."""
        held, size = [], 0
        for g in rows:
            held.append(self._row(g, low / PLACES))
            size += len(held[-1][0])
            if size >= AT_ONCE or g == rows[-1]:
                value, n, same = map(np.concatenate, zip(*held))
                place = np.minimum((value * PLACES).astype(np.int64), PLACES - 1)
                wanted = (value > 0) & (n > 0) & (place >= low) & (place < high)
                yield place[wanted], value[wanted], n[wanted], same[wanted]
                held, size = [], 0


def ratio_auc(spans: DataFrame, pairs: int, positives: int) -> float | None:
    """Area under the ROC curve of the ratio over all pairs; exact, ties at half. ``spans``: (rank, t0, t1) of each account.

    The values are made from the spans where they are needed: once for counts
    of 65,536 places, then for each range of places with about RANGE pairs,
    which one task sorts. So no pair is moved or written.
    """
    negatives = pairs - positives
    if not positives or not negatives:
        return None

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([packed_table(pa.Table.from_batches(held))], pa.binary())], ["data"])

    kept = written(spans.groupBy("rank", "t0", "t1").agg(F.count(F.lit(1)).alias("n")).repartition(1).mapInArrow(packed, "data binary"), "spans")
    stripes = max(1, min(4096, -(-pairs // STRIPE)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column("id").to_pylist(), batch.column("data")):
                of = _Spans(unpacked(data))
                pos, n = np.zeros(PLACES), np.zeros(PLACES)
                for place, _, many, same in of.above_zero(range(i, len(of.rank), stripes), 0, PLACES):
                    n += np.bincount(place, many, PLACES)
                    pos += np.bincount(place, many * same, PLACES)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(pos[some].astype(np.int64)), pa.array(n[some].astype(np.int64))], ["place", "pos", "n"])

    counts = for_each(stripes, kept, count, "place long, pos long, n long").groupBy("place").agg(F.sum("pos"), F.sum("n")).orderBy("place").collect()
    ranges, size = [], 0
    for place, _, n in counts:
        if not ranges or size + n > RANGE:
            ranges.append([place, place + 1])
            size = 0
        ranges[-1][1] = place + 1
        size += n

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column("id").to_pylist(), batch.column("data")):
                of = _Spans(unpacked(data))
                found = [x[1:] for x in of.above_zero(range(len(of.rank)), *ranges[i])]
                value, many, same = map(np.concatenate, zip(*found))
                at = np.argsort(value)
                value, many, same = value[at], many[at].astype(float), same[at]
                begin = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
                pos, n = np.add.reduceat(many * same, begin), np.add.reduceat(many, begin)
                won = float((pos * (np.cumsum(n - pos) - (n - pos) / 2)).sum())
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([int(pos.sum())]), pa.array([int(n.sum())]), pa.array([won])], ["id", "pos", "n", "won"])

    sorted_ = for_each(len(ranges), kept, order, "id long, pos long, n long, won double").collect() if ranges else []
    pos, n = (sum(r[c] for r in sorted_) for c in ("pos", "n"))
    below = pairs - n - (positives - pos)  # pairs without overlap have zero
    won = (positives - pos) * below / 2
    for r in sorted(sorted_, key=lambda r: r["id"]):
        won += r["won"] + r["pos"] * below
        below += r["n"] - r["pos"]
    return won / (float(positives) * negatives)

"""Exact top-k by inner product on a bit-sliced index.

Components become integers; a block of rows stores, for each component, one
bitmap per bit. A query adds the bitmaps of its weights' digits with
carry-save adders, which gives the bit slices of all scores of the block at
once; the k best rows are chosen from the highest slice downward, and the rows
that tie at the boundary are settled by their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written

#: Components below this add up in 64-bit integers; blocks with larger ones use Python's.
PLAIN = 2**24
ROWS_PER_BLOCK = 65_536
QUERIES_PER_BLOCK = 65_536
LONG = (-(2**63), 2**63 - 1)


def quantised(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(row, vec_id, v array<double> of whole numbers) of the rows that take part, written once; ``row`` names a row.

    NULL ids and vectors, and vectors with a NULL or non-finite component,
    take no part. Repeated ids and rows stay rows of their own. Other columns
    are left out.
    """
    x = F.col(vector)
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    taken = rows.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(F.forall(x, fine))
    taken = taken.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: _floor(c.cast("double") * scale)).alias("v"))
    return written(taken.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _floor(c: Column) -> Column:
    """The floor as a double; from 2**53 on a double is whole already."""
    return F.when(F.abs(c) < float(2**53), F.floor(c).cast("double")).otherwise(c)


def _whole(vectors: np.ndarray) -> np.ndarray:
    """Whole doubles as integers that sums of products fit."""
    if not vectors.size or np.abs(vectors).max() < PLAIN:
        return vectors.astype(np.int64)
    return np.array([[int(x) for x in v] for v in vectors], object).reshape(vectors.shape)


class Slices:
    """The bit-sliced index of one block: rows in id order, a bitmap of 64-row words per component and bit."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, vectors = ids[order], vectors[order]
        self.place = {r: i for i, r in enumerate(rows[order].tolist())}
        self.n, self.dim = vectors.shape
        self.words = -(-self.n // 64)
        self.least = vectors.min(axis=0) if self.dim else np.zeros(0, np.int64)
        raised = vectors - self.least
        self.bits = [int(x).bit_length() for x in (raised.max(axis=0) if self.dim else [])]
        self.maps = [[self._bitmap((raised[:, d] >> b) & 1) for b in range(self.bits[d])] for d in range(self.dim)]
        self.inverse = [[~m for m in maps] for maps in self.maps]
        self.all = self._bitmap(np.ones(self.n, np.int64))

    def _bitmap(self, bit: np.ndarray) -> np.ndarray:
        whole = np.zeros(self.words * 64, np.uint8)
        whole[: self.n] = bit
        return np.packbits(whole, bitorder="little").view("<u8")

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bit slices of a score that is never negative, lowest first, and what to add to it.

        A weight is written in digits -1, 0 and 1. A digit -1 adds the
        inverted bitmaps, which count 2**bits - 1 too much.
        """
        levels: list[list[np.ndarray]] = [[]]
        base = sum(int(w) * int(x) for w, x in zip(query, self.least))
        for d, weight in enumerate(query.tolist()):
            at = 0
            while weight:
                if weight & 1:
                    digit = 2 - (weight & 3)
                    weight -= digit
                    chosen = self.maps[d] if digit > 0 else self.inverse[d]
                    if digit < 0:
                        base -= ((1 << self.bits[d]) - 1) << at
                    while len(levels) < at + len(chosen):
                        levels.append([])
                    for b, m in enumerate(chosen):
                        levels[at + b].append(m)
                weight >>= 1
                at += 1
        return _add(levels, self.words), base

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int]]:
        """(ids, scores) of the k best rows but the row ``own``, unordered."""
        slices, base = self.scores(query)
        left = self.all.copy()
        if (at := self.place.get(own)) is not None:
            left[at >> 6] &= ~np.uint64(1 << (at & 63))
        sure, n_sure = np.zeros_like(left), 0
        for s in reversed(slices):
            ones = left & s
            n = int(np.bitwise_count(ones).sum())
            if n_sure + n > k:
                left = ones
            else:
                sure, n_sure = sure | ones, n_sure + n
                left &= ~s
                if n_sure == k:
                    left[:] = 0
                    break
        chosen = np.concatenate([_positions(sure), _positions(left)[: k - n_sure]])
        word, shift = chosen >> 6, (chosen & 63).astype(np.uint64)
        score = [base] * len(chosen)
        for b, s in enumerate(slices):
            bit = ((s[word] >> shift) & np.uint64(1)).tolist()
            score = [x + (y << b) for x, y in zip(score, bit)]
        return self.ids[chosen], score


def _positions(bitmap: np.ndarray) -> np.ndarray:
    word = np.flatnonzero(bitmap)
    bit = np.unpackbits(bitmap[word].view(np.uint8), bitorder="little").reshape(-1, 64)
    row, col = np.nonzero(bit)
    return word[row] * 64 + col


def _add(levels: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Sum bitmaps of weights 2**0, 2**1, ...: three of a weight become one of it and one of the next."""
    out, at = [], 0
    while at < len(levels):
        here = levels[at]
        if len(here) > 1 and at + 1 == len(levels):
            levels.append([])
        while len(here) > 2:
            a, b, c = here.pop(), here.pop(), here.pop()
            half = a ^ b
            carry = a & b
            carry |= half & c
            half ^= c
            here.append(half)
            levels[at + 1].append(carry)
        if len(here) == 2:
            a, b = here
            levels[at + 1].append(a & b)
            here = [a ^ b]
        out.append(here[0] if here else np.zeros(words, np.uint64))
        at += 1
    return out


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    rows_per_block: int = ROWS_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows but its own; ties go to the smaller id.

    Both inputs are (row, vec_id, v) as :func:`quantised` makes them. Rows and
    queries are dealt by a hash of ``row`` into blocks of about the given
    sizes, with at least as many cells as the cluster has cores, and every pair
    of blocks of one dimension is a cell. A worker reads the rows of its cell,
    builds their index once and answers the queries as they stream past, so it
    holds one block of rows. Each cell returns k rows per query, of which the
    best k stay. Queries that share an id each get their own rows. A score
    beyond the range of a long stands at its end. An empty table or query set
    gives no rows.
    """
    n, q = rows.count(), queries.count()
    r_blocks = max(1, -(-n // rows_per_block))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, -(-q // queries_per_block), min(-(-cores // r_blocks), q))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    slim = lambda df: df.select("row", "vec_id", "v", F.size("v").alias("dim"))
    index = slim(rows).withColumn("rb", block(r_blocks)).withColumn("qb", numbers(q_blocks)).withColumn("asks", F.lit(False))
    asked = slim(queries).withColumn("qb", block(q_blocks)).withColumn("rb", numbers(r_blocks)).withColumn("asks", F.lit(True))
    cell = ["dim", "rb", "qb"]
    cells = index.unionByName(asked).repartition(*cell).sortWithinPartitions(*cell, "asks")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, slices = None, [], None
        for pdf in frames:
            change = (pdf[cell] != pdf[cell].shift()).any(axis=1).to_numpy().copy()
            change |= (pdf["asks"] != pdf["asks"].shift()).to_numpy()
            cuts = [*np.flatnonzero(change).tolist(), len(pdf)]
            for a, b in zip(cuts, cuts[1:]):
                part = pdf.iloc[a:b]
                here = tuple(part[cell].iloc[0])
                if here != now:
                    now, held, slices = here, [], None
                if not part["asks"].iloc[0]:
                    held.append(part)
                    continue
                if held:
                    every = pd.concat(held)
                    slices = Slices(every["vec_id"].to_numpy(np.int64), every["row"].to_numpy(np.int64), _whole(_matrix(every["v"])))
                    held = []
                if slices is not None:
                    yield answers(slices, part)

    def answers(slices: Slices, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, name, vector in zip(part["row"], part["vec_id"], _whole(_matrix(part["v"]))):
            found, score = slices.top(vector, int(own), k)
            out += [(own, name, i, min(max(s, LONG[0]), LONG[1])) for i, s in zip(found.tolist(), score)]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"])

    found = cells.mapInPandas(run, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), float).reshape(len(vectors), -1)

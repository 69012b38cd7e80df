"""Pairwise features of owned accounts, from the public ledger only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LearnConfig
from ..storage import written
from .edges import VALUE_MOVE, activation_records, funded_sources, peel_matches
from .groups import burst_groups, window_groups

FEATURES = (
    "fee_payer_jaccard",
    "dest_jaccard",
    "coburst",
    "windowed_copay",
    "funding_hop",
    "activation_lineage",
    "peel",
    "timespan_overlap",
)


#: Accounts a block of the pair table, and the least number of blocks.
BLOCK, LEAST_BLOCKS = 4096, 8
#: Pairs, and meetings of two accounts at an item, that a worker counts at once.
PAIRS_AT_ONCE, MEETINGS_AT_ONCE = 1 << 16, 1 << 20
#: Kinds of rows of a cell: features 0 to 4 are sets of items, 5 and 6 counted pairs, SPAN holds first and last time, and
#: LABEL, where it is asked for, the rank of the operator.
SETS, COUNTED, SPAN, LABEL = range(5), range(5, 7), 7, 8
CELL, OF_ACCOUNT = ["p", "q"], ["source", "kind", "item", "w", "w2"]


def _count(pairs: DataFrame, out: str) -> DataFrame:
    """Rows per unordered pair."""
    return (
        pairs.filter("a <> b")
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.count(F.lit(1)).alias(out))
    )


class _Sets:
    """The items of one kind: those of each row account, and the column accounts that have them too."""

    def __init__(self, row: np.ndarray, row_item: np.ndarray, column: np.ndarray, column_item: np.ndarray, n: tuple[int, int]):
        self.size = np.bincount(row, minlength=n[0]), np.bincount(column, minlength=n[1])  # a NULL counts, but meets nothing
        row, row_item, column, column_item = row[row_item >= 0], row_item[row_item >= 0], column[column_item >= 0], column_item[column_item >= 0]
        order = np.argsort(column_item, kind="stable")
        self.having, held, self.width = column[order], column_item[order], n[1]
        order = np.argsort(row, kind="stable")
        self.row, item = row[order], row_item[order]
        self.begin = np.searchsorted(held, item)
        self.many = np.searchsorted(held, item, side="right") - self.begin

    def common(self, low: int, high: int) -> np.ndarray:
        """Items that the row accounts from low to high share with each column account."""
        out = np.zeros((high - low) * self.width, np.int64)
        at, stop = np.searchsorted(self.row, (low, high))
        ends, first, done = np.cumsum(self.many[at:stop]), at, 0
        while at < stop:
            upto = max(at + 1, int(first + np.searchsorted(ends, done + MEETINGS_AT_ONCE, side="right")))
            many = self.many[at:upto]
            place = np.repeat(self.begin[at:upto] - np.cumsum(many) + many, many) + np.arange(many.sum())
            out += np.bincount(np.repeat((self.row[at:upto] - low) * self.width, many) + self.having[place], minlength=len(out))
            at, done = upto, ends[upto - first - 1]
        return out.reshape(high - low, self.width)


def tiles(table: pa.Table, alone: bool) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """All pairs of one cell, some rows of it at a time: names, the places of both ends there, features.

    ``alone``: of one block with itself. Names are sorted; ends are not.
    """
    kind, right, w, w2 = (table.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "right", "w", "w2"))
    name = table.column("source").combine_chunks()
    is_span = kind == SPAN
    names = name.filter(pa.array(is_span))
    order = pc.sort_indices(names).to_numpy()  # by bytes, as Spark compares
    names, right_name = names.take(order), right[is_span][order]
    t0, t1 = (x[is_span][order].astype(float) for x in (w, w2))
    rows, columns = (np.arange(len(names)),) * 2 if alone else (np.flatnonzero(~right_name), np.flatnonzero(right_name))
    local = np.empty(len(names), np.int64)
    local[columns], local[rows] = np.arange(len(columns)), np.arange(len(rows))
    who = pc.index_in(name, names).to_numpy(zero_copy_only=False)
    shape = len(rows), len(columns)
    sets = []
    for k in SETS:
        here = kind == k
        item = table.column("item").filter(pa.array(here)).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        mine, left = local[who[here]], ~right[here]
        sets.append(_Sets(mine, item, mine, item, shape) if alone else _Sets(mine[left], item[left], mine[~left], item[~left], shape))
    counted = []
    for k in COUNTED:
        here = kind == k
        a = who[here]
        b = pc.index_in(table.column("item").filter(pa.array(here)).combine_chunks(), names).fill_null(-1).to_numpy(zero_copy_only=False)
        n = w[here]
        met = b >= 0  # a block holds what its accounts count with those of any other
        a, b, n = a[met], b[met], n[met]
        if not alone:
            met = right_name[a] != right_name[b]
            a, b, n = a[met], b[met], n[met]
        swap = a > b if alone else right_name[a]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        by_row = np.argsort(local[a], kind="stable")
        counted.append((local[a][by_row], local[b][by_row], n[by_row]))
    step = max(1, PAIRS_AT_ONCE // max(1, shape[1]))
    for low in range(0, shape[0], step):
        high = min(low + step, shape[0])
        x, y = np.meshgrid(rows[low:high], columns, indexing="ij")
        wanted = x < y if alone else np.ones(x.shape, bool)
        made = []
        for k, s in zip(SETS, sets):
            both = s.common(low, high)
            if FEATURES[k].endswith("jaccard"):
                made.append(both / np.maximum(s.size[0][low:high, None] + s.size[1][None, :] - both, 1))
            else:
                made.append(np.log1p(both))
        for i, j, n in counted:
            of = slice(*np.searchsorted(i, (low, high)))
            dense = np.zeros(x.shape)
            dense[i[of] - low, j[of]] = np.log1p(n[of].astype(float))
            made.append(dense)
        over = np.fmin(t1[x], t1[y]) - np.fmax(t0[x], t0[y])
        within = np.fmax(t1[x], t1[y]) - np.fmin(t0[x], t0[y])
        made.append(np.fmax(over, 0) / np.fmax(within, 1))
        yield names, x[wanted], y[wanted], [m[wanted] for m in made]


def _cell(table: pa.Table, alone: bool) -> Iterator[pa.RecordBatch]:
    for names, x, y, made in tiles(table, alone):
        ends = [names.take(pa.array(f(x, y))) for f in (np.minimum, np.maximum)]
        yield pa.RecordBatch.from_arrays([*ends, *map(pa.array, made)], ["a", "b", *FEATURES])


def pair_features(public: DataFrame, owned: DataFrame, cfg: LearnConfig) -> DataFrame:
    """(a, b, eight features) of every pair a < b of the accounts in ``owned``.

    The pair table is quadratic in the owned accounts by definition, so no
    pair is ever moved: accounts stand in blocks, two of which, or one alone,
    are a cell. A cell gets its accounts' sets of fee payers, destinations and
    groups and counts there what each two of them share, and the pairs of the
    two rules that are counted as such (activation and peel). A block is
    written once, as one value; a cell reads its two blocks from shared storage,
    so what is shuffled and written grows with the ledger only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells_of(batches):
            yield from _cell(*cell)

    return cells(account_blocks(public, owned, cfg)).mapInArrow(run, "a string, b string, " + ", ".join(f"{f} double" for f in FEATURES))


def cells(blocks: DataFrame) -> DataFrame:
    """Every two blocks, and each with itself. Each task reads its own: nothing is shuffled or broadcast."""
    p, q = (blocks.select(F.col("own").alias(x), F.col("data").alias(f"of_{x}")) for x in CELL)
    return p.hint("shuffle_replicate_nl").join(q, F.col("p") <= F.col("q"))


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """In a worker: the accounts' rows of each cell, and whether it is one block with itself."""
    for batch in batches:
        for i in range(len(batch)):
            alone = batch.column("p")[i].as_py() == batch.column("q")[i].as_py()
            sides = [unpacked(batch.column(c)[i]) for c in ("of_p", "of_q")[: 2 - alone]]
            flagged = [t.append_column("right", pa.array(np.full(len(t), k == 1))) for k, t in enumerate(sides)]
            yield pa.concat_tables(flagged).combine_chunks(), alone


def packed_table(table: pa.Table) -> bytes:
    to = pa.BufferOutputStream()
    with pa.ipc.new_stream(to, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    return to.getvalue().to_pybytes()


def unpacked(value: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all()


def account_blocks(public: DataFrame, owned: DataFrame, cfg: LearnConfig) -> DataFrame:
    """(own, data): the blocks, written once; with the accounts' ranks if ``owned`` has a column ``rank``."""
    ids = owned.select(F.col("account").alias("source"))
    mine = lambda df: df.join(ids, "source", "left_semi")
    ends = lambda df: (
        df.join(ids.withColumnRenamed("source", "a"), "a", "left_semi").join(
            ids.withColumnRenamed("source", "b"), "b", "left_semi"
        )
    )
    seen = mine(public)
    item = lambda c: F.col(c).cast("string") if isinstance(c, str) else c
    windowed = F.concat(F.col("group_id").cast("string"), F.lit(":"), F.col("dest"))  # NULL without a destination
    sources = [
        (seen, "fee_payer"),
        (seen, "dest"),
        (mine(burst_groups(public)), "group_id"),
        (mine(window_groups(public, cfg.copay_window_secs)), windowed),
        (mine(funded_sources(public, 1)), "funder"),
    ]
    none, no_item = F.lit(None).cast("long"), F.lit(None).cast("string")
    sets = [
        df.select("source", item(c).alias("item")).distinct().select("source", F.lit(k).alias("kind"), "item", none.alias("w"), none.alias("w2"))
        for k, (df, c) in zip(SETS, sources)
    ]
    span = seen.groupBy("source").agg(F.min("ts").cast("long").alias("w"), F.max("ts").cast("long").alias("w2"))
    of_accounts = reduce(DataFrame.unionByName, sets).unionByName(
        span.select("source", F.lit(SPAN).alias("kind"), no_item.alias("item"), "w", "w2")
    )
    if "rank" in owned.columns:
        ranks = owned.select(F.col("account").alias("source"), F.lit(LABEL).alias("kind"), no_item.alias("item"), F.col("rank").cast("long").alias("w"), none.alias("w2"))
        of_accounts = of_accounts.unionByName(ranks)
    blocks = max(LEAST_BLOCKS, -(-ids.count() // BLOCK))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).alias("own")
    every = of_accounts.select(block, *OF_ACCOUNT)
    rules = [
        activation_records(public, cfg.activation_window_secs),
        peel_matches(public, cfg.peel_window_secs, cfg.amount_tolerance_bps),
    ]
    for k, df in zip(COUNTED, rules):
        pairs = _count(ends(df), "w").join(span.select(F.col("source").alias("a")), "a", "left_semi").join(span.select(F.col("source").alias("b")), "b", "left_semi")
        pairs = pairs.select(F.col("a").alias("source"), F.lit(k).alias("kind"), F.col("b").alias("item"), "w", none.alias("w2"))
        every = every.unionByName(pairs.select(block, *OF_ACCOUNT))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: int | None = None

        def one() -> Iterator[pa.RecordBatch]:
            if held:
                data = packed_table(pa.Table.from_batches(held).select(OF_ACCOUNT).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([data], pa.binary())], ["own", "data"])

        for batch in batches:
            own = batch.column("own").to_numpy()
            change = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)] if len(own) else [0]
            for at, upto in zip(change, change[1:]):
                if int(own[at]) != now:
                    yield from one()
                    held, now = [], int(own[at])
                held.append(batch.slice(at, upto - at))
        yield from one()

    return written(every.repartition(blocks, "own").sortWithinPartitions("own").mapInArrow(packed, "own long, data binary"), "blocks")


__all__ = ["FEATURES", "VALUE_MOVE", "pair_features"]

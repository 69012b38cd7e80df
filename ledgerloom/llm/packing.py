"""Packing of documents into sequences by cutting stock.

Documents are cut at multiples of the sequence length; the remainders are the
stock problem. Their lengths, in classes of ``grain`` ids, form a histogram
(its size is fixed, whatever the corpus). Patterns of classes that fit one
sequence come from column generation: a linear program over the patterns so
far, whose dual prices a knapsack by dynamic programming turns into the next
pattern. The plan is rounded down, the rest is placed by best fit, and the
documents, ranked within their class, take the places.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..storage import written
from .bpe import mapped
from .words import Packed, sliced

LIMIT = 4096
GRAIN = 8
END_ID = 2
#: Bytes of known words a worker.
REMEMBER = 128_000_000


#: ASCII punctuation and letters or digits.
MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
ALNUM = frozenset(c for c in range(0x21, 0x7F) if chr(c).isalnum())


def _lower_letters(run: bytes) -> bool:
    """Whether normaliser and pre-tokeniser leave the run as it is, one pre-token, so that the model alone suffices.

    So it is for lower-case letters below U+0250: they are composed already.
    """
    if run.isalpha():
        return run.islower()
    word = run.decode()
    return word.isalpha() and max(word) < "\u0250" and word == word.lower()


class Ids:
    """Ids by a ``tokenizers`` file, remembered per white-space-free run.

    Neither its normaliser nor its pre-tokens reach across ASCII white space,
    so the ids of a text are those of its runs, one after another. It lowers
    case first, so runs are looked up in lower case, unless the text may hold
    the name of a special token. A letter or digit and the punctuation that
    ends its run are apart as well, so a new run is first parted there.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        self.tokenizer = Tokenizer.from_file(path)
        self.known = Packed(remember)

    def _learn(self, runs: list[bytes]) -> None:
        other, tokenize, found = [], self.tokenizer.model.tokenize, {}
        for r in runs:
            if _lower_letters(r):
                found[r] = array("I", [t.id for t in tokenize(mapped(r))]).tobytes()
            else:
                other.append(r)
        self.known.learn(found)
        for at in range(0, len(other), 10_000):
            some = other[at : at + 10_000]
            made = self.tokenizer.encode_batch_fast([r.decode() for r in some], add_special_tokens=False)
            self.known.learn({r: array("I", e.ids).tobytes() for r, e in zip(some, made)})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts = []
        for t in texts:
            data = t.encode() if t else b""
            parts.append((data if b"<|" in data else data.lower()).split())
        known, seen = self.known, set().union(*parts)
        known.room()
        new, halves, need = [r for r in seen if r not in known], [], []
        for r in new:
            core = r.rstrip(MARKS)
            if core and len(core) < len(r) and core[-1] in ALNUM and b"<|" not in r:
                halves.append((r, core, r[len(core) :]))
                need += halves[-1][1:]
            else:
                need.append(r)
        self._learn([r for r in set(need) if r not in known])
        known.learn({r: known[core] + known[tail] for r, core, tail in halves})
        get = known.__getitem__
        return [b"".join(map(get, p)) for p in parts]


@cache
def ids_of(path: str, remember: int = REMEMBER) -> Ids:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Ids(path, remember)


def _cut(doc_ids: pa.Array, ids: list[bytes], limit: int) -> pa.RecordBatch:
    at, start, length, crc, total = [], [], [], [], []
    for i, data in enumerate(ids):
        view, n = memoryview(data), len(data) // 4
        for s in range(0, n, limit):
            e = min(s + limit, n)
            at.append(i)
            start.append(s)
            length.append(e - s)
            crc.append(zlib.crc32(view[4 * s : 4 * e]))
            total.append(n)
    longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(at, pa.int64())), *longs], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    )


def pieces(
    docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, remember: int = REMEMBER
) -> DataFrame:
    """Tokenise whole texts, add the end id and cut at multiples of the limit.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens.
    """
    kind, end = dict(docs.dtypes)["doc_id"], np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ids_of(path, remember)
        for batch in batches:
            for part in sliced(batch, "text", 2_000_000):
                ids = [x + end for x in t.encode(part.column("text").to_pylist())]
                yield _cut(part.column("doc_id"), ids, limit)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def best_pattern(price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Unbounded knapsack: the class counts of the greatest price; class c takes c + 1 units."""
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    n = len(price)
    for room in range(1, capacity + 1):
        m = min(n, room)
        options = value[room - 1 :: -1][:m] + price[:m]
        best = int(np.argmax(options))
        if options[best] > value[room - 1] + 1e-12:
            value[room], choice[room] = options[best], best + 1
        else:
            value[room], choice[room] = value[room - 1], 0
    pattern, room = np.zeros(n, np.int64), capacity
    while room > 0:
        if choice[room] == 0:
            room -= 1
        else:
            pattern[choice[room] - 1] += 1
            room -= choice[room]
    return pattern, float(value[capacity])


def column_generation(demand: np.ndarray, capacity: int, rounds: int = 4_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each, to meet the demand with the fewest sequences.

    A revised simplex: the basis starts with one pattern per class; each round
    brings in the pattern of the best price. It ends when no price is above 1,
    or when the bound that the best price gives (objective over price) shows
    that at most a ten-thousandth can still be won. Demands are moved by less
    than a thousandth of a document, so that no two patterns leave at once.
    """
    use = np.flatnonzero(demand)
    m = len(use)
    if not m:
        return []
    basis = np.zeros((m, m))
    np.fill_diagonal(basis, capacity // (use + 1))
    inverse = np.diag(1.0 / basis.diagonal())
    level = inverse @ (demand[use] + np.random.default_rng(1).random(m) * 1e-3)
    price = np.zeros(capacity)
    for _ in range(rounds):
        price[use] = np.maximum(inverse.sum(axis=0), 0)
        pattern, worth = best_pattern(price, capacity)
        if worth <= 1 + 1e-7 or level.sum() * (1 - 1 / worth) < min(0.01, 1e-4 * level.sum()):
            break
        step = inverse @ pattern[use]
        enters = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[enters] = level[enters] / step[enters]
        out = int(np.argmin(ratio))
        theta = ratio[out]
        level = np.maximum(level - theta * step, 0)
        level[out] = theta
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out] = pattern[use]
    found = []
    for column, x in zip(basis.T, level):
        if x > 1e-9:
            whole = np.zeros(capacity, np.int64)
            whole[use] = column
            found.append((whole, float(x)))
    return found


def plan(demand: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern as (class, count) pairs, how many sequences)] that covers the demand exactly."""
    left = demand.astype(np.int64).copy()
    out: list[tuple[list[tuple[int, int]], int]] = []
    for pattern, x in sorted(column_generation(demand, capacity), key=lambda p: -p[1]):
        items = np.flatnonzero(pattern)
        times = int(min(int(x + 1e-2), (left[items] // pattern[items]).min()))
        if times > 0:
            left[items] -= times * pattern[items]
            out.append(([(int(c), int(pattern[c])) for c in items], times))
    # what rounding leaves: best fit, longest first; equal bins are counted, not listed
    bins: dict[tuple, int] = {}
    for pattern_ in _best_fit(left, capacity):
        bins[pattern_] = bins.get(pattern_, 0) + 1
    for pattern_, times in bins.items():
        counts: dict[int, int] = {}
        for c in pattern_:
            counts[c] = counts.get(c, 0) + 1
        out.append((sorted(counts.items()), times))
    return out


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple]:
    room: list[tuple[int, int]] = []
    held: list[list[int]] = []
    for c in range(len(left) - 1, -1, -1):
        for _ in range(int(left[c])):
            at = bisect_left(room, (c + 1, -1))
            if at == len(room):
                held.append([c])
                insort(room, (capacity - c - 1, len(held) - 1))
            else:
                free, k = room.pop(at)
                held[k].append(c)
                insort(room, (free - c - 1, k))
    return [tuple(h) for h in held]


def _places(plan_: list[tuple[list[tuple[int, int]], int]]) -> dict[int, list[np.ndarray]]:
    """Per class: first rank, first sequence, copies and first slot of each run of places."""
    taken: dict[int, int] = {}
    out: dict[int, list[tuple]] = {}
    first = 0
    for pattern, times in plan_:
        slot = 0
        for c, copies in reversed(pattern):
            out.setdefault(c, []).append((taken.get(c, 0), first, copies, slot))
            taken[c] = taken.get(c, 0) + times * copies
            slot += copies
        first += times
    return {c: [np.array(x, np.int64) for x in zip(*rows)] for c, rows in out.items()}


def pack(cut: DataFrame, limit: int = LIMIT, grain: int = GRAIN) -> DataFrame:
    """Give each piece a sequence_id and its offset there; other columns stay.

    ``cut`` is read twice, so it is written once to shared storage. The driver
    sees one count per length class, at most ``limit / grain``. Ranks within a
    class are counted per (class, bucket of a hash), so one frequent length is
    spread over many tasks.
    """
    spark = cut.sparkSession
    capacity = -(-limit // grain)
    cut = written(cut.withColumn("_class", F.floor((F.col("length") - 1) / grain).cast("int")), "pieces")
    buckets = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = cut.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    demand = np.zeros(capacity, np.int64)
    for r in sizes.groupBy("_class").agg(F.sum("_n").alias("n")).collect():
        demand[r["_class"]] = r["n"]
    places = _places(plan(demand, capacity))
    before = sizes.select(
        "_class",
        "_bucket",
        F.coalesce(
            F.sum("_n").over(W.partitionBy("_class").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    order = W.partitionBy("_class", "_bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        cut.withColumn("_in", F.row_number().over(order) - 1)
        .join(before, ["_class", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_in"))
        .drop("_before", "_in", "_bucket")
    )

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            seq, slot = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            cls, rank = pdf["_class"].to_numpy(), pdf["_rank"].to_numpy()
            for c in np.unique(cls):
                mine = np.flatnonzero(cls == c)
                start, first, copies, base = places[int(c)]
                run = np.searchsorted(start, rank[mine], side="right") - 1
                step = rank[mine] - start[run]
                seq[mine] = first[run] + step // copies[run]
                slot[mine] = base[run] + step % copies[run]
            yield pdf.drop(columns=["_class", "_rank"]).assign(sequence_id=seq, _slot=slot)

    kept = [(c, t) for c, t in ranked.dtypes if c not in ("_class", "_rank")]
    schema = ", ".join(f"`{c}` {t}" for c, t in kept) + ", sequence_id long, _slot long"
    placed = ranked.mapInPandas(place, schema)
    here = W.partitionBy("sequence_id").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(here), F.lit(0))).drop("_slot")


def pack_documents(
    docs: DataFrame, path: str, limit: int = LIMIT, grain: int = GRAIN, remember: int = REMEMBER
) -> DataFrame:
    """Tokenise, cut and pack whole documents.

    A NULL or empty text holds only the end id. A NULL doc_id is packed like
    any other; repeated rows are packed once each. An empty table gives no
    rows. Columns beside doc_id and text take no part.
    """
    cut = pieces(docs, path, limit, remember=remember)
    return pack(cut, limit, grain).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )

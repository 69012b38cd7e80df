"""Near duplicates by SimHash fingerprints, compared on vertical bit planes.

Fingerprints that differ in at most three bits agree on one of four bands, so
only those that share a band's value meet. Inside such a bucket the
fingerprints stand in blocks of 64, one machine word per bit position; a
fingerprint is compared with a whole block at once, two carry-save counters
hold 64 distances, and a block is left as soon as all its distances are past
the radius. A bucket that is too large is parted again by four bands of the
bits that its members need not share, as often as needed.

For a similarity of 0.8 that radius is too small, and the distance of wide
fingerprints only estimates it. There sets of distinct five-word shingles that
share one of their first few hashes meet, as all sets that similar do. Inside
such a bucket the bit planes of wide fingerprints leave out what is far, and
parity maps what cannot be similar enough. The pairs that are left are compared
shingle by shingle: first those of a forest of nearest neighbours, then those
that it has not joined. The forests of all buckets make families, outside of
which nothing is similar; a family that the links do not hold together gets its
whole sets in one place, so that no pair has to travel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..operators.components import connected_components
from ..storage import written
from .rows import sent, unwrapped, wrapped
from .words import forget, sliced, words

RADIUS = 3
BITS = 64
SHINGLE = 3
#: Buckets above this are parted again; at the last of LEVELS at most 2**20 different fingerprints share one.
LARGEST = 1024
LEVELS = 4

#: Five-word shingles, and the 64-bit words of a wide fingerprint and of a parity map of them.
WIDE_SHINGLE, WIDE_WORDS, PARITY_WORDS = 5, 4, 4
#: Shingles that more sets have are moved to the end of the order, in so many rounds at most.
HOT, COOLED = 16_384, 3
SIMILARITY = 0.8
#: A family's sets are dealt to blocks of so many shingles at most on average; one of more than SPREAD blocks stays in its buckets.
BLOCK_SHINGLES, SPREAD = 1 << 21, 16
#: So many standard deviations beyond the mean distance of a pair at the limit a fingerprint may lie; the last
#: ones are for sets of few shingles, whose ties move the mean.
DEVIATIONS = 7.5
#: The increment and the two factors of the splitmix64 generator.
_STEP, _FACTORS = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """The XXH64 of every shingle; of the whole text, if it has fewer words; none without words."""
    run = [w.lower() for w in words(text)]
    if not run:
        return np.empty(0, "<u8")
    joined = map(b" ".join, zip(*(run[i:] for i in range(shingle)))) if len(run) >= shingle else [b" ".join(run)]
    return np.array([xxhash.xxh64_intdigest(s, seed) for s in joined], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; no words give zero."""
    h = _hashes(text, shingle, seed)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """A bit is 1 if it is set in over half of the distinct shingles, whose hashes are widened by splitmix64."""
    h = shingles.view(np.uint64)
    ones = np.zeros(BITS * WIDE_WORDS, np.int64)
    steps = np.arange(1, WIDE_WORDS + 1, dtype=np.uint64) * np.uint64(_STEP)
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096, None] + steps
        for shift, factor in zip((30, 27), _FACTORS):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # as many as a byte can count
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def parity_map(shingles: np.ndarray) -> bytes:
    """Per value of some hash bits, whether it is found an odd number of times.

    An element that only one of two sets has turns one bit, so their maps
    differ in no more bits than the sets in elements.
    """
    n = BITS * PARITY_WORDS
    odd = np.bincount((shingles & (n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _with_digest(docs: DataFrame, name: str, kind: str, digest: Callable[[list], pa.Array]) -> DataFrame:
    rest = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                made = digest(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, name])
        batch = part = made = None
        forget()

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(name, DataType.fromDDL(kind))]))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Add fp, the fingerprint of the whole text as a signed long, to each row."""

    def digest(texts: list) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return _with_digest(docs, "fp", "long", digest)


def band_masks(levels: int = LEVELS, parts: int = RADIUS + 1) -> list[list[int]]:
    """Per level, the shared bits of each path of band choices: path p at one level has children p * parts + c."""
    out = []
    for level in range(1, levels + 1):
        masks = []
        for path in product(range(parts), repeat=level):
            left, shared = list(range(BITS)), 0
            for c in path:
                cut = [len(left) * i // parts for i in range(parts + 1)]
                chosen = left[cut[c] : cut[c + 1]]
                shared |= sum(1 << b for b in chosen)
                left = left[: cut[c]] + left[cut[c + 1] :]
            masks.append(shared - (1 << 64) if shared >> 63 else shared)
        out.append(masks)
    return out


def _deal(members: DataFrame, masks: list[int]) -> DataFrame:
    """One row per member and band: path and the shared bits."""
    parts = RADIUS + 1
    split = members.withColumn("child", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    path = split.select("fp", (F.col("path") * parts + F.col("child")).cast("int").alias("path"))
    table = F.array(*(F.lit(m).cast("long") for m in masks))
    return path.withColumn("key", F.col("fp").bitwiseAND(F.element_at(table, F.col("path") + 1)))


def buckets(distinct: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(path, key, fp) of all buckets of two and more fingerprints, large ones parted again."""
    done: DataFrame | None = None
    members = distinct.select("fp", F.lit(0).alias("path"))
    all_masks = band_masks()
    for level, masks in enumerate(all_masks):
        dealt = _deal(members, masks)
        sizes = dealt.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = written(dealt.join(sizes, ["path", "key"]), "bands")
        last = level + 1 == len(all_masks)
        small = sized if last else sized.filter(F.col("n") <= largest)
        small = small.select("path", "key", "fp", F.lit(level).alias("level"))
        done = small if done is None else done.unionByName(small)
        members = sized.filter(F.col("n") > largest).select("fp", "path")
        if last or members.isEmpty():
            return done
    raise AssertionError


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three bit vectors."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


class Planes:
    """Blocks of 64 fingerprints as vertical words, one per bit position. Lanes have the shape (blocks, 64, words)."""

    def __init__(self, lanes: np.ndarray, at_once: int = 1024):
        wide = lanes.shape[2]
        self.planes = np.empty((BITS * wide, len(lanes)), np.uint64)
        at_once = max(1, at_once // wide)
        for at in range(0, len(lanes), at_once):
            part = np.ascontiguousarray(lanes[at : at + at_once])
            bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 64, 8 * wide), axis=2, bitorder="little")
            across = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little")
            self.planes[:, at : at + at_once] = np.ascontiguousarray(across).view("<u8")[:, :, 0]

    def near(
        self, query: np.ndarray, block: np.ndarray, live: np.ndarray, radius: int = RADIUS
    ) -> tuple[np.ndarray, np.ndarray]:
        """For each (query, block): the lanes of ``live`` within the radius. Returns the pairs that have some.

        Counters are slices of weight 1, 2, 4 and so on. They start where the
        radius' successor makes the highest slice carry over, which ends a lane.
        """
        item, one, zero = np.arange(len(query)), np.uint64(1), np.uint64(0)
        n_slices = max(3, radius.bit_length())
        start = (1 << n_slices) - 1 - radius
        count = [np.full(len(query), ~zero if start >> i & 1 else zero) for i in range(n_slices)]
        for eight in range(0, len(self.planes), 8):
            word = query[:, eight // BITS]
            d = [self.planes[p][block] ^ (zero - ((word >> np.uint64(p % BITS)) & one)) for p in range(eight, eight + 8)]
            twos, fours = [], []
            for x, y in zip(d[::2], d[1::2]):
                count[0], carry = _add(count[0], x, y)
                twos.append(carry)
            for x, y in zip(twos[::2], twos[1::2]):
                count[1], carry = _add(count[1], x, y)
                fours.append(carry)
            count[2], over = _add(count[2], *fours)
            for i in range(3, n_slices):
                over, count[i] = count[i] & over, count[i] ^ over
            live = live & ~over
            keep = live != 0
            if np.count_nonzero(keep) < 0.8 * len(keep):
                query, block, live, item = (x[keep] for x in (query, block, live, item))
                count = [x[keep] for x in count]
                if not len(item):
                    break
        keep = live != 0
        return item[keep], live[keep]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows the smallest label; in place."""
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def near_pairs(
    fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS, items_at_once: int = 32_768
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some at a time, the pairs of rows of one bucket within the radius; rows of a bucket stand together.

    A row of ``fp`` holds the words of one fingerprint. An item is a row
    against a block of 64.
    """
    n = len(fp)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, n])
    start = np.repeat(first, size)
    lane = np.arange(n) - start
    n_blocks = -(-size // 64)
    block_of_bucket = np.cumsum(n_blocks) - n_blocks
    own_block = np.repeat(block_of_bucket, size) + lane // 64
    lanes = np.zeros((int(n_blocks.sum()), 64, fp.shape[1]), np.uint64)
    lanes[own_block, lane % 64] = fp
    row_of = np.full(lanes.shape[:2], -1, np.int64)
    row_of[own_block, lane % 64] = np.arange(n)
    held = np.zeros(len(lanes), np.int64)
    np.add.at(held, own_block, 1)
    full = np.where(held >= 64, ~np.uint64(0), (np.uint64(1) << (held % 64).astype(np.uint64)) - np.uint64(1))
    planes = Planes(lanes)
    # each row meets its own block's later lanes and the bucket's later blocks
    reach = np.repeat(block_of_bucket + n_blocks, size) - own_block
    ends = np.cumsum(reach)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + items_at_once, side="right")))
        mine = np.arange(at, upto)
        query = np.repeat(mine, reach[mine])
        step = np.arange(len(query)) - np.repeat(np.cumsum(reach[mine]) - reach[mine], reach[mine])
        block = own_block[query] + step
        above = ~np.uint64(0) << (lane[query] % 64).astype(np.uint64)
        above ^= np.uint64(1) << (lane[query] % 64).astype(np.uint64)
        live = np.where(step == 0, full[block] & above, full[block])
        item, found = planes.near(fp[query], block, live, radius)
        if len(item):
            bit = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            hit, col = np.nonzero(bit)
            yield query[item[hit]], row_of[block[item[hit]], col]
        at = upto


def forest(fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Labels (row numbers) of the components within each bucket; rows of a bucket stand together."""
    label = np.arange(len(fp))
    for a, b in near_pairs(fp, bucket, radius):
        _unite(label, a, b)
    return label


def _per_bucket(
    bucketed: DataFrame, keys: list[str], name: str, solve: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]],
    rows_at_once: int, schema: str = "a long, b long",
) -> DataFrame:
    """What ``solve(rows, bucket)`` makes, which gets whole buckets of two rows and more, many at once."""
    dealt = bucketed.repartition(*keys).sortWithinPartitions(*keys, name)

    def whole(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        change = np.zeros(len(pdf), bool)
        for c in keys:
            v = pdf[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        bucket = np.cumsum(change)
        met = np.bincount(bucket)[bucket] > 1 if len(pdf) else change
        if met.any():
            yield from solve(pdf[met].reset_index(drop=True), bucket[met])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for pdf in frames:
            held.append(pdf)
            n += len(pdf)
            if n < rows_at_once:
                continue
            every = pd.concat(held, ignore_index=True)
            last = every[keys].iloc[-1]
            begun = int(np.argmax((every[keys] == last).all(axis=1).to_numpy()))  # the last bucket may go on in the next frame
            if begun:
                yield from whole(every.iloc[:begun])
                every = every.iloc[begun:]
            held, n = [every], -len(every)  # so a bucket that fills it all is looked at again only when it has doubled
        if held:
            yield from whole(pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(run, schema)


def links(bucketed: DataFrame, rows_at_once: int = 50_000) -> DataFrame:
    """(a, b): for each bucket, a star per component of fingerprints linked inside it; never all pairs."""

    def solve(pdf: pd.DataFrame, bucket: np.ndarray) -> Iterator[pd.DataFrame]:
        ids = pdf["fp"].to_numpy(np.int64)
        label = forest(ids.view(np.uint64).reshape(-1, 1), bucket)
        tied = np.flatnonzero(label != np.arange(len(label)))
        yield pd.DataFrame({"a": ids[label[tied]], "b": ids[tied]})

    return _per_bucket(bucketed, ["level", "path", "key"], "fp", solve, rows_at_once)


def classes(distinct: DataFrame, largest: int = LARGEST) -> DataFrame:
    """Add ``root``, one fingerprint for each class of linked ones, to a table of distinct ones."""
    roots = connected_components(links(buckets(distinct.select("fp"), largest))).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, largest: int = LARGEST) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that links of at most three bits can reach.

    Equal fingerprints are one node, so copies cost nothing; those of empty
    and NULL texts are zero and link like any other. Repeated rows come out as
    often as they came in. A NULL doc_id belongs to its component but never
    names it, unless it has no other member (NULL then). An empty table gives
    no rows; columns beside doc_id and text take no part.
    """
    marked = written(fingerprints(docs.select("doc_id", "text"), shingle).drop("text"), "fingerprints")
    rooted = classes(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), largest)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def representatives(docs: DataFrame, shingle: int = SHINGLE, largest: int = LARGEST) -> DataFrame:
    """One row of each class: that with the smallest doc_id, of equal ones any, one with a NULL id only if all have it.

    Other columns are carried along, whatever their names; an empty table gives no rows.
    """
    rows = wrapped(docs, "doc_id", "text").withColumn("id", F.monotonically_increasing_id())
    marked = written(fingerprints(rows, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "id"))
    rooted = classes(marked.groupBy("fp").agg(first.alias("least")), largest)
    chosen = rooted.groupBy("root").agg(F.min("least")["id"].alias("id")).select("id")
    return marked.join(chosen, "id", "left_semi").select(*unwrapped(docs.columns, "doc_id", "text"))


def radius_of(similarity: float, bits: int = BITS * WIDE_WORDS, deviations: float = DEVIATIONS) -> int:
    """The bits within which fingerprints of two sets of this Jaccard similarity lie.

    They differ in a binomial number of bits, whose rate the angle of equally
    large sets gives; that many deviations above its mean lie about one in
    10**13, and for sets of a few shingles one in 10**7.
    """
    rate = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * rate + deviations * math.sqrt(bits * rate * (1 - rate)))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles as ascending signed hashes."""
    return np.unique(_hashes(text, WIDE_SHINGLE, 42).view(np.int64))


def prefix_length(n: int, similarity: Fraction) -> int:
    """Two sets that similar share one of so many first elements of theirs, in any order common to all sets."""
    return n + math.floor(-similarity * n) + 1 if n else 0


def _sets(texts: DataFrame) -> DataFrame:
    """(id, shingles) of a table (id, text)."""

    def digest(texts: list) -> pa.Array:
        return pa.array([shingle_set(t) for t in texts], pa.list_(pa.int64()))

    return _with_digest(texts, "shingles", "array<bigint>", digest).drop("text")


def _shared(entries: DataFrame, similarity: Fraction) -> DataFrame:
    """The entries (key, id, n) whose key more than one has; k tells how many. A hot key is counted on every side first.

    Two sets alone are left out where their sizes differ too much for the similarity.
    """
    counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low"), F.max("n").alias("high"))
    counts = counts.filter(f"k > 2 or k = 2 and {similarity.denominator} * low >= {similarity.numerator} * high")
    return written(entries.join(counts.select("key", "k"), "key"), "shared")


def _frequent(scans: list[DataFrame], keys: DataFrame, above: int) -> DataFrame:
    """(key): those that more than ``above`` rows of ``keys`` are; each row is in an array of a row of ``scans`` too.

    Such a key is in one task of the scans more often than its even share, so
    only what is that frequent in a task is counted in all; other keys never move.
    """
    tasks = sum(s.rdd.getNumPartitions() for s in scans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).flatten().to_numpy(zero_copy_only=False) for b in batches]
        if held:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key[n * tasks > above], pa.int64())], ["key"])

    found = [s.mapInArrow(run, "key long") for s in scans]
    likely = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    likely = written(likely.distinct(), "likely")
    counted = keys.join(sent(likely), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    return written(counted.filter(F.col("k") > above).select("key"), "hot")


def _drawn(texts: DataFrame, late: np.ndarray, similarity: Fraction) -> DataFrame:
    """(id, n, prefix) of a table (id, text), with the shingles in ``late``, which ascend, at the end of the order."""

    def digest(texts: list) -> pa.Array:
        sets = [shingle_set(t) for t in texts]
        prefixes = []
        for h in sets:
            found = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h
            prefixes.append(np.concatenate([h[~found], h[found]])[: prefix_length(len(h), similarity)])
        columns = {"n": pa.array([len(h) for h in sets], pa.int32()), "prefix": pa.array(prefixes, pa.list_(pa.int64()))}
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return _with_digest(texts, "set", "struct<n: int, prefix: array<bigint>>", digest).select("id", "set.n", "set.prefix")


def _cooled(sketches: DataFrame, texts: DataFrame, similarity: Fraction, hot_from: int) -> DataFrame:
    """The shared entries, with keys of more than ``hot_from`` ids at the end of the order of all sets.

    Any one order of all sets will do, so nothing is lost; a prefix without
    such a key stays as it is, and the others are drawn again from whole sets,
    in which all their frequent keys are counted. That may bring up further
    ones, for at most COOLED rounds; blocks hold what stays. The entries meet
    only once, when their order is settled. The hot keys, of which there is one
    in ``hot_from`` shingles at most, are sent to every worker.
    """
    prefixes = sketches.select("id", F.col("n").cast("int").alias("n"), "prefix")
    keys = lambda df, c: df.select(F.explode(c).alias("key"))
    now, hot = prefixes, _frequent([prefixes.select("prefix")], keys(prefixes, "prefix"), hot_from)

    def touched(hot: DataFrame) -> DataFrame:
        """The ids with a hot key in their prefix."""
        of = prefixes.select("id", F.explode("prefix").alias("key"))
        return written(of.join(F.broadcast(hot), "key", "left_semi").select("id").distinct(), "ids")

    for _ in range(COOLED):
        if hot.isEmpty():
            break
        sets = written(_sets(texts.join(sent(touched(hot)), "id", "left_semi")).select("shingles"), "sets")
        hot = written(hot.unionByName(_frequent([sets], keys(sets, "shingles"), hot_from)).distinct(), "hot")
        ids = touched(hot)
        late = np.sort(hot.toPandas()["key"].to_numpy(np.int64))
        drawn = written(_drawn(texts.join(sent(ids), "id", "left_semi"), late, similarity), "drawn")
        # whole prefixes are left out, not their entries one by one
        now = prefixes.join(sent(ids), "id", "left_anti").unionByName(drawn)
        more = _frequent([prefixes.select("prefix"), drawn.select("prefix")], keys(now, "prefix"), hot_from)
        more = written(more.join(F.broadcast(hot), "key", "left_anti"), "hot")
        if more.isEmpty():
            break
        hot = written(hot.unionByName(more), "hot")
    return _shared(now.select("id", "n", F.explode("prefix").alias("key")), similarity)


BUCKET = ["key", "p", "q"]


def _dealt(shared: DataFrame, largest: int) -> DataFrame:
    """(key, p, q, side, id): a key's ids are dealt to blocks of about ``largest``, and each two blocks, or one alone, are a bucket."""
    return _in_blocks(shared.select("key", "id", F.ceil(F.col("k") / largest).alias("blocks")))


def _in_blocks(keyed: DataFrame) -> DataFrame:
    """(key, p, q, side, id) of (key, id, blocks)."""
    dealt = keyed.withColumn("side", F.pmod(F.xxhash64("id"), "blocks"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return other.select("key", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "id")


def _spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b) at distance d those that join the rows: in each round every component takes its nearest one."""
    order = np.argsort(d, kind="stable")
    a, b, taken = a[order], b[order], []
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return tuple(np.concatenate([t[i] for t in taken] or [a[:0]]) for i in (0, 1))
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        first = np.unique(np.concatenate([np.unique(s, return_index=True)[1] for s in (x, y)]))
        taken.append((a[first], b[first]))
        _unite(label, a[first], b[first])


def _candidates(met: DataFrame, similarity: Fraction, forest_only: bool, rows_at_once: int = 20_000) -> DataFrame:
    """(key, p, q, a, b) of one bucket and of different roots that may be similar enough; or a forest of nearest ones of them.

    ``met`` is (key, p, q, side, id, root, n, fp, odd). What is left out lies
    beyond the radius of the fingerprints, or its sizes or parity maps differ
    too much for the similarity.
    """
    num, den, radius = similarity.numerator, similarity.denominator, radius_of(float(similarity))

    def solve(pdf: pd.DataFrame, bucket: np.ndarray) -> Iterator[pd.DataFrame]:
        ids, n, side = (pdf[c].to_numpy(np.int64) for c in ("id", "n", "side"))
        fp, odd = (np.frombuffer(b"".join(pdf[c]), "<u8").reshape(len(pdf), -1) for c in ("fp", "odd"))
        alone = (pdf["p"] == pdf["q"]).to_numpy()
        groups = pd.DataFrame({"b": bucket, "r": pdf["root"]}).groupby(["b", "r"]).ngroup().to_numpy()
        label = np.unique(groups, return_index=True)[1][groups]
        for i, j in near_pairs(fp, bucket, radius, 4096):
            fine = (alone[i] | (side[i] != side[j])) & (label[i] != label[j])
            fine &= den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
            i, j = i[fine], j[fine]
            apart = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64)
            fine = (den + num) * apart <= (den - num) * (n[i] + n[j])
            i, j = i[fine], j[fine]
            if forest_only:
                i, j = _spanning(label, i, j, np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64))
            if len(i):
                at = {c: pdf[c].to_numpy()[i] for c in BUCKET}
                yield pd.DataFrame({**at, "a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])})

    return _per_bucket(met, BUCKET, "id", solve, rows_at_once, "key long, p long, q long, a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs whose whole sets have at least this Jaccard similarity."""
    own, both = similarity.numerator, similarity.numerator + similarity.denominator
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("shingles").alias(f"of_{side}")), side)
    common = "cast(size(array_intersect(of_a, of_b)) as long)"
    return pairs.filter(f"{both} * {common} >= {own} * (size(of_a) + size(of_b))").select("a", "b")


def _family_links(met: DataFrame, similarity: Fraction, rows_at_once: int = 2048) -> DataFrame:
    """(a, b): links that join the different roots of one bucket whose whole sets are similar enough; never all pairs.

    ``met`` is (key, p, q, side, id, root, fp, odd, shingles).
    """
    num, den, radius = similarity.numerator, similarity.denominator, radius_of(float(similarity))

    def joined(pdf: pd.DataFrame, bucket: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        ids, side = (pdf[c].to_numpy(np.int64) for c in ("id", "side"))
        fp, odd = (np.frombuffer(b"".join(pdf[c]), "<u8").reshape(len(pdf), -1) for c in ("fp", "odd"))
        alone = (pdf["p"] == pdf["q"]).to_numpy()
        groups = pd.DataFrame({"b": bucket, "r": pdf["root"]}).groupby(["b", "r"]).ngroup().to_numpy()
        label = np.unique(groups, return_index=True)[1][groups]
        code = np.unique(np.concatenate(pdf["shingles"].tolist()), return_inverse=True)[1].astype(np.int32)
        ends, own, found = np.cumsum(n), np.zeros(int(code.max()) + 1, bool), []
        for i, j in near_pairs(fp, bucket, radius, 4096):
            fine = (alone[i] | (side[i] != side[j])) & (label[i] != label[j])
            fine &= den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
            i, j = i[fine], j[fine]
            apart = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64)
            fine = (den + num) * apart <= (den - num) * (n[i] + n[j])
            i, j = i[fine], j[fine]
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else i
            for x, to in zip(i[cuts].tolist(), np.split(j, cuts[1:])):
                to = to[label[to] != label[x]]
                if not len(to):
                    continue
                mine = code[ends[x] - n[x] : ends[x]]
                own[mine] = True
                starts = np.cumsum(n[to]) - n[to]
                every = np.repeat(ends[to] - n[to] - starts, n[to]) + np.arange(n[to].sum())
                common = np.add.reduceat(own[code[every]], starts, dtype=np.int64)
                own[mine] = False
                to = to[(den + num) * common >= num * (n[x] + n[to])]
                to = to[np.unique(label[to], return_index=True)[1]]
                if len(to):
                    found += [(ids[x], y) for y in ids[to]]
                    _unite(label, np.full(len(to), x), to)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def solve(pdf: pd.DataFrame, bucket: np.ndarray) -> Iterator[pd.DataFrame]:
        n = pdf["shingles"].map(len).to_numpy(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        share = (np.cumsum(n)[first] - n[first]) // BLOCK_SHINGLES  # buckets that begin in one share go together
        cuts = [*first[np.r_[True, share[1:] != share[:-1]]].tolist(), len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            yield joined(pdf.iloc[a:b].reset_index(drop=True), bucket[a:b], n[a:b])
        forget()

    return _per_bucket(met, BUCKET, "id", solve, rows_at_once)


def similar_links(
    texts: DataFrame, sketches: DataFrame, similarity: float, largest: int = LARGEST, hot_from: int = HOT,
    spread: int = SPREAD,
) -> DataFrame:
    """(a, b): links that join all ids whose shingle sets have at least this Jaccard similarity, and no others.

    ``texts`` is (id, text), ``sketches`` (id, n, prefix, fp, odd): the size of
    the set, its first shingles, as :func:`prefix_length` has it, its
    fingerprint and its parity map. Every similar pair shares a first shingle
    and so a bucket. A forest of nearest neighbours per bucket is compared
    first; then every pair that may be similar and that its links have not
    joined, so a large group of near copies does not bring all its pairs.
    What may be similar is of one family, a component of these forests. Sets of
    a family with several classes meet whole, in blocks, and yield links only;
    in a family of more than ``spread`` blocks, whose sets would be sent too
    often, the pairs of its buckets are looked up instead, all of them.
    """
    t = Fraction(str(similarity))
    shared = _cooled(sketches, texts, t, hot_from)
    marks = sketches.select("id", "n", "fp", "odd")
    dealt = _dealt(shared, largest)
    trees = written(_candidates(dealt.join(marks, "id").withColumn("root", F.col("id")), t, True), "trees")
    nearest = written(trees.select("a", "b").distinct(), "pairs")
    # whatever has a neighbour has one in a tree
    ids = written(nearest.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = written(_sets(texts.join(sent(ids), "id", "left_semi")), "sets")
    linked = written(_verified(nearest, sets, t), "links")
    roots = connected_components(linked)
    named = roots.withColumnRenamed("node", "id")
    kin = connected_components(nearest).select(F.col("node").alias("id"), F.col("root").alias("key"))
    members = kin.join(named, "id", "left").withColumn("root", F.coalesce("root", "id"))
    members = written(members.join(sets.select("id", F.size("shingles").cast("long").alias("n")), "id"), "families")
    families = members.groupBy("key").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / (4 * largest)), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"),
        F.min("root").alias("low"), F.max("root").alias("high"),
    )
    split = written(families.filter("low <> high").select("key", "blocks"), "families")
    ties = roots.filter("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b"))
    near = _in_blocks(members.select("key", "id").join(split.filter(F.col("blocks") <= spread), "key"))
    met = near.join(members.select("id", "root"), "id").join(marks.drop("n"), "id").join(sets, "id")
    found = ties.unionByName(_family_links(met, t))
    wide = split.filter(F.col("blocks") > spread)
    if wide.isEmpty():
        return found
    # a bucket whose tree the links hold together has no more to say
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    ends = trees.join(of("a"), "a", "left").join(of("b"), "b", "left")
    open_ = ends.filter("coalesce(root_a, a) <> coalesce(root_b, b)").select(*BUCKET).distinct()
    far = members.join(wide, "key", "left_semi").select("id", "root")
    rooted = dealt.join(open_, BUCKET, "left_semi").join(far, "id").join(marks, "id")
    more = _candidates(rooted, t, False).select("a", "b").distinct()
    rest = written(more.join(nearest, ["a", "b"], "left_anti"), "pairs")
    return found.unionByName(_verified(rest, sets, t))


def sketched(docs: DataFrame, similarity: Fraction, out: str) -> DataFrame:
    """Add ``out``, a struct of the shingle set's name (a digest of its hashes), n, prefix, fp and odd."""

    def digest(texts: list) -> pa.Array:
        sets = [shingle_set(t) for t in texts]
        columns = {
            "name": pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()),
            "n": pa.array([len(h) for h in sets], pa.int64()),
            "prefix": pa.array([h[: prefix_length(len(h), similarity)] for h in sets], pa.list_(pa.int64())),
            "fp": pa.array([wide_fingerprint(h) for h in sets], pa.binary()),
            "odd": pa.array([parity_map(h) for h in sets], pa.binary()),
        }
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    kind = "struct<name: binary, n: bigint, prefix: array<bigint>, fp: binary, odd: binary>"
    return _with_digest(docs, out, kind, digest)


def similar_representatives(
    docs: DataFrame, similarity: float = SIMILARITY, largest: int = LARGEST, hot_from: int = HOT
) -> DataFrame:
    """One row of each class of texts whose five-word shingles are similar: that with the smallest doc_id.

    Texts link if the Jaccard similarity of their distinct shingles is at
    least this. Equal sets are one node; empty and NULL texts share one, and a
    text of fewer than five words is one shingle. Of repeated rows and of equal
    ids one row stays, and one with a NULL id only if its class has no other.
    An empty table gives no rows. Long texts take part whole. Other columns are
    carried along, whatever their names.
    """
    exact = Fraction(str(similarity))
    rows = wrapped(docs, "doc_id", "text").withColumn("id", F.monotonically_increasing_id())
    marked = written(sketched(rows, exact, "set"), "shingles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", F.col("id").alias("row")))
    distinct = marked.groupBy("set.name").agg(first.alias("least"))
    distinct = written(distinct.select("least", F.col("least.row").alias("id")), "distinct")
    sketches = marked.select("id", "set.n", "set.prefix", "set.fp", "set.odd").join(distinct, "id", "left_semi")
    sketches = written(sketches, "sketches")
    linked = similar_links(marked.select("id", "text"), sketches, similarity, largest, hot_from)
    roots = connected_components(linked).withColumnRenamed("node", "id")
    rooted = distinct.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    chosen = rooted.groupBy("root").agg(F.min("least")["row"].alias("id")).select("id")
    dropped = written(marked.select("id").join(chosen, "id", "left_anti"), "dropped")
    return marked.join(sent(dropped), "id", "left_anti").select(*unwrapped(docs.columns, "doc_id", "text"))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

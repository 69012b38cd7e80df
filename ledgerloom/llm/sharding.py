"""Shards of near equal size: the minimax contiguous partition of groups of equal texts.

Groups are atomic. In their order every shard begins with large groups, dealt
largest first to the shard that has least, and goes on with small ones, which
stand in descending order of size and are described by one count per class of
sizes. Over that order the smallest capacity that a greedy filling of the
shards can keep is found by bisection; the shards are cut where the greedy
filling at that capacity ends them. The small groups at the end of each shard
let it end close to the capacity.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written

SHARDS = 40
ROW_BYTES = 16
#: Parts of a run of equally large groups that a cut falls into.
PARTS = 1024
#: A group of more than this part of an even share is large, so there are fewer than so many per shard.
LARGE_PART = 256
#: Sizes from 2**CLASS_BITS on are counted by so many leading bits, which bounds the classes.
CLASS_BITS = 12


class Order:
    """The small groups in descending order of size, as runs (class, groups, bytes)."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        self.runs = sorted(runs, reverse=True)
        self.bytes = [0, *accumulate(b for _, _, b in self.runs)]
        self.groups = [0, *accumulate(n for _, n, _ in self.runs)]

    def bytes_before(self, group: int) -> int:
        if group >= self.groups[-1]:
            return self.bytes[-1]
        r = bisect_right(self.groups, group) - 1
        _, n, total = self.runs[r]
        return self.bytes[r] + (group - self.groups[r]) * total // n

    def fill(self, start: int, capacity: int) -> int:
        """The group after the last that fits when filling from ``start``."""
        upto = self.bytes_before(start) + capacity
        if upto >= self.bytes[-1]:
            return self.groups[-1]
        r = bisect_right(self.bytes, upto) - 1
        _, n, total = self.runs[r]
        return max(start, self.groups[r] + (upto - self.bytes[r]) * n // total)

    def greedy(self, held: list[int], capacity: int) -> list[int] | None:
        """Where each shard, which holds so much already, ends among the small groups; None if the capacity is too small."""
        at, ends = 0, []
        for h in held:
            if h > capacity:
                return None
            at = self.fill(at, capacity - h)
            ends.append(at)
        return ends if at == self.groups[-1] else None


def deal(sizes: list[int], shards: int) -> tuple[list[int], list[int]]:
    """The shard of each size, largest first to the shard that has least, and what the shards hold then."""
    held, out = [(0, s) for s in range(shards)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        total, s = heapq.heappop(held)
        out[i] = s
        heapq.heappush(held, (total + sizes[i], s))
    return out, [t for t, _ in sorted(held, key=lambda x: x[1])]


def cut(order: Order, held: list[int]) -> list[int]:
    """First small group of each shard but the first, at the smallest capacity that the greedy filling can keep.

    Shards that hold more than an even share of the rest already take nothing
    more, and do not set the capacity of the others.
    """
    left = list(range(len(held)))
    while True:
        share = (order.bytes[-1] + sum(held[s] for s in left)) / len(left)
        less = [s for s in left if held[s] <= share]
        if len(less) == len(left):
            break
        left = less
    own = [held[s] for s in left]
    low, high = max(own), order.bytes[-1] + sum(own)
    while low < high:
        middle = (low + high) // 2
        if order.greedy(own, middle) is None:
            low = middle + 1
        else:
            high = middle
    ends = dict(zip(left, order.greedy(own, low)))
    return list(accumulate((ends.get(s, 0) for s in range(len(held) - 1)), max))


def _located(groups: DataFrame, order: Order, cuts: list[int]) -> list[tuple]:
    """Each cut as (class, part, key) of the first group behind it; part and key are None at the start of a run.

    Equally large groups are ordered by (part, key). A count per part leads to
    the part that holds the cut, and only its groups are ranked.
    """
    cuts = [c if c < order.groups[-1] else None for c in cuts]  # None: behind all small groups
    beyond = [(-1, None, None) for c in cuts if c is None]
    cuts = [c for c in cuts if c is not None]
    at = [bisect_right(order.groups, c) - 1 for c in cuts]
    spots = [(order.runs[r][0], c - order.groups[r]) for r, c in zip(at, cuts)]
    inside = sorted({s for s, rank in spots if rank})
    if not inside:
        return [(s, None, None) for s, _ in spots] + beyond
    here = groups.filter(F.col("class").isin(inside))
    counts: dict[int, list] = {}
    for r in here.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["class"], []).append((r["part"], r["n"]))
    wanted = {}
    for size, rank in spots:
        left = rank
        for part, n in sorted(counts[size]) if rank else ():
            if left < n:
                wanted[size, rank] = (size, part, left + 1)
                break
            left -= n
    spot = lambda *cols: F.concat_ws(":", *cols)
    held = here.filter(spot("class", "part").isin([f"{s}:{p}" for s, p, _ in wanted.values()]))
    ranked = held.withColumn("_n", F.row_number().over(W.partitionBy("class", "part").orderBy("g")))
    first = ranked.filter(spot("class", "part", "_n").isin([f"{s}:{p}:{n}" for s, p, n in wanted.values()]))
    keys = {(r["class"], r["part"], r["_n"]): r["g"] for r in first.collect()}
    return [(s, wanted[s, k][1], keys[wanted[s, k]]) if k else (s, None, None) for s, k in spots] + beyond


def _behind(cut_at: tuple) -> Column:
    """Whether a small group stands behind the cut."""
    size, part, key = cut_at
    if part is None:
        return F.col("class") <= size
    within = (F.col("part") > part) | ((F.col("part") == part) & (F.col("g") >= F.lit(bytes(key))))
    return (F.col("class") < size) | ((F.col("class") == size) & within)


def _class(total: Column) -> Column:
    """The size, with the bits behind the leading ones cleared."""
    bits = F.length(F.conv(total, 10, 2)) - CLASS_BITS
    return F.when(bits <= 0, total).otherwise(total - F.pmod(total, F.expr("cast(1 as bigint)") * F.pow(F.lit(2), bits).cast("long")))


def shard(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Equal texts stay together; a NULL text counts as empty. Repeated rows are
    rows of their own, a NULL doc_id is dealt like any other, a long text may
    fill a shard alone, an empty table gives no rows; other columns take no
    part. The driver sees fewer than LARGE_PART large groups per shard, a count
    per class of sizes, of which there are below 100,000 at any input, and then
    a bounded number of rows per cut. Group totals meet the rows in an
    equi-join whose hot keys adaptive execution splits, and slots are counted
    per shard and part of a hash, so neither a frequent text nor a shard lands
    in one task.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + row_bytes).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("g"),
        ),
        "sizes",
    )
    groups = rows.groupBy("g").agg(F.sum("size").alias("total"))
    part = F.pmod(F.xxhash64("g"), F.lit(PARTS)).cast("int")
    groups = written(groups.withColumns({"part": part, "class": _class(F.col("total"))}), "groups")
    whole = groups.agg(F.sum("total")).first()[0] or 0
    is_large = F.col("total") * (LARGE_PART * shards) > whole
    large = groups.filter(is_large).select("g", "total").orderBy(F.desc("total"), "g").collect()
    small = groups.filter(~is_large)
    runs = small.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("b")).collect()
    order = Order([(r["class"], r["n"], r["b"]) for r in runs])
    dealt_to, held = deal([r["total"] for r in large], shards)
    cuts = _located(small, order, cut(order, held)) if runs else []
    number = sum((F.when(_behind(c), 1).otherwise(0) for c in cuts), F.lit(0))
    own = spark.createDataFrame([(bytes(r["g"]), s) for r, s in zip(large, dealt_to)], "g binary, own int")
    groups = groups.join(F.broadcast(own), "g", "left")  # fewer than LARGE_PART * shards rows
    groups = groups.select("g", F.coalesce("own", number.cast("int")).alias("shard"))
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.join(groups, "g").select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int").alias("_part"),
    )
    dealt = written(dealt, "shards")
    before = F.sum("_n").over(W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = dealt.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("shard", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32"))
    return (
        dealt.withColumn("_in", inside)
        .join(offsets, ["shard", "_part"])
        .withColumn("slot", (F.col("_before") + F.col("_in") - 1).cast("long"))
        .select("doc_id", "size", "text_crc32", "shard", "slot")
    )


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    return shard(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

"""Removal of passages that an earlier document holds, by super-k-mers of words.

A window is 13 consecutive words. Its minimiser is the least three-word gram
inside it, where long grams come first, as they are the rare ones. Consecutive
windows with one minimiser travel as one packed string to the minimiser's
bucket; there all windows are sorted, equal ones stand together, and each
learns the smallest doc_id in which it starts.

A sender, which is some megabytes of documents, sends a string once, with the
places where it found it. The places of a string that one sender finds very
often do not go to the bucket; they wait beside it and are joined with what
the bucket says about the string, so a passage that a third of all documents
share does not gather in one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..storage import release, written
from .rows import unwrapped, wrapped
from .words import forget, words

WINDOW = 13
GRAM = 3
SENDER_BYTES = 5 << 20
BUCKET_BYTES = 3 << 20
#: A string that one sender finds in more places keeps them apart from its bucket.
OFTEN = 16

#: Odd numbers to mix with; kept in an array, where products wrap around silently.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
#: Powers of the base and of its inverse modulo 2**64: the first SPAN, and those of every SPAN-th place as far as needed.
_SPAN = 4096


def _row(base: int, n: int) -> np.ndarray:
    row = np.full(n, base, np.uint64)
    row[0] = 1
    return np.cumprod(row)


_INVERSE = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = _row(_BASE, _SPAN), _row(_INVERSE, _SPAN)


class _Text:
    """Lines of words that one space parts: where each word stands, and hashes of any run of bytes."""

    def __init__(self, data: bytes):
        self.data = data
        byte = np.frombuffer(data, np.uint8)
        newline = byte == 10
        gap = np.flatnonzero(newline | (byte == 32))
        self.start, self.end = np.r_[0, gap + 1], np.r_[gap, len(byte)]
        self.line = np.r_[0, np.cumsum(newline[gap])]
        spans = len(byte) // _SPAN + 1
        self.far = _row(pow(_INVERSE, _SPAN, 1 << 64), spans)
        # in place, as an array of the bytes' number takes eight times their room
        self.sums = np.zeros(len(byte) + 1, np.uint64)
        for i, up in enumerate(_row(pow(_BASE, _SPAN, 1 << 64), spans)):
            part = byte[i * _SPAN : (i + 1) * _SPAN]
            self.sums[i * _SPAN + 1 : i * _SPAN + 1 + len(part)] = _BYTE[part] * (_UP[: len(part)] * up)
        np.cumsum(self.sums, out=self.sums)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit polynomial hash of the bytes from start to end."""
        out = self.sums[end] - self.sums[start]
        out *= _DOWN[start % _SPAN]
        out *= self.far[start // _SPAN]
        return out


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive keys, by doubling."""
    least, span = keys, 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def minimisers(h: np.ndarray, lens: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The minimiser key of the window that starts at each word."""
    n = len(h) - gram + 1
    mixed, size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for j in range(gram):
        mixed = (mixed ^ h[j : n + j]) * _MIX[j % 3]
        size += lens[j : n + j]
    mixed ^= mixed >> np.uint64(29)
    rare = (255 - np.minimum(size, 255)).astype(np.uint64)
    return _sliding_min(rare << np.uint64(56) | mixed >> np.uint64(8), window - gram + 1)


class _Sender:
    """Documents gathered until they are cut into super-k-mers and packed per bucket."""

    def __init__(self, buckets: int, often: int):
        self.often, self.buckets, self.pack = often, buckets, zstandard.ZstdCompressor(level=5).compress
        self.reset()

    def reset(self) -> None:
        self.lines, self.doc, self.tag, self.bytes = [], [], [], 0

    def add(self, doc: int, tag: int, text: str) -> None:
        w = words(text)
        if len(w) >= WINDOW:
            self.lines.append(b" ".join(w))
            self.doc.append(doc)
            self.tag.append(tag)
            self.bytes += len(self.lines[-1])

    def flush(self) -> Iterator[tuple[int, bytes | None, bytes]]:
        """(bucket, key of a string found often or None, packed body)."""
        if not self.lines:
            return
        text = _Text(b"\n".join(self.lines))
        key = minimisers(text.hashes(text.start, text.end), text.end - text.start)
        owner = text.line
        valid = owner[: len(key)] == owner[WINDOW - 1 :]
        begin = valid.copy()
        begin[1:] &= ~valid[:-1] | (key[1:] != key[:-1]) | (owner[1 : len(key)] != owner[: len(key) - 1])
        first = np.flatnonzero(begin)
        ends = np.flatnonzero(valid & np.r_[~valid[1:] | begin[1:], True])
        bucket = ((key[first] * _MIX[0]) >> np.uint64(24)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        first, ends, bucket = first[order], ends[order], bucket[order].astype(np.int64)
        left, right = text.start[first].tolist(), text.end[ends + WINDOW - 1].tolist()
        who, data = owner[first], text.data
        begins = np.searchsorted(owner, np.arange(len(self.lines)))
        doc, tag = np.array(self.doc, np.int64)[who], np.array(self.tag, np.int64)[who]
        start = (first - begins[who]).astype(np.int32)
        del text, key, valid, begin
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() + [len(bucket)]
        for a, b in zip(cuts, cuts[1:]):
            index: dict[bytes, int] = {}
            which = np.array([index.setdefault(data[x:y], len(index)) for x, y in zip(left[a:b], right[a:b])])
            yield from self._body(int(bucket[a]), list(index), which, doc[a:b], tag[a:b], start[a:b])
        self.reset()

    def _body(self, bucket: int, strings: list[bytes], which, doc, tag, start) -> Iterator[tuple[int, bytes | None, bytes]]:
        n = np.bincount(which, minlength=len(strings))
        order = np.argsort(which, kind="stable")
        which, doc, tag, start = which[order], doc[order], tag[order], start[order]
        often = n > self.often
        at = np.r_[0, np.cumsum(n)]
        low, high = np.minimum.reduceat(doc, at[:-1]), np.maximum.reduceat(doc, at[:-1])
        for s in np.flatnonzero(often):
            here = slice(at[s], at[s + 1])
            yield bucket, xxhash.xxh128_digest(strings[s]), self._places(doc[here], tag[here], start[here])
        keep = ~often[which]
        text = b"\n".join(strings)
        head = struct.pack("<III", len(strings), int(keep.sum()), len(text))
        counts = np.where(often, 0, n).astype("<i4")
        body = [head, text, counts.tobytes(), low[often].tobytes(), high[often].tobytes()]
        body.append(self._raw(doc[keep], tag[keep], start[keep]))
        yield bucket, None, self.pack(b"".join(body))

    @staticmethod
    def _raw(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> bytes:
        step = np.diff(doc, prepend=np.int64(0)) if len(doc) else doc
        return step.astype("<i8").tobytes() + tag.astype("<i8").tobytes() + start.astype("<i4").tobytes()

    def _places(self, doc, tag, start) -> bytes:
        return self.pack(struct.pack("<I", len(doc)) + self._raw(doc, tag, start))


def _places(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc = np.cumsum(np.frombuffer(data, "<i8", n))
    return doc, np.frombuffer(data, "<i8", n, 8 * n), np.frombuffer(data, "<i4", n, 16 * n)


SENT = "bucket long, often binary, body binary"


def send(docs: DataFrame, buckets: int, often: int = OFTEN) -> DataFrame:
    """Super-k-mers of the documents (doc_id long, tag long, text), packed per bucket and sender."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets, often)

        def rows() -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for row in sender.flush():
                held.append(row)
                size += len(row[2])
                if size > 4 << 20:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

        def batch_of(held: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["bucket", "often", "body"])

        for batch in batches:
            for doc, tag, text in zip(*(batch.column(c) for c in ("doc_id", "tag", "text"))):
                sender.add(doc.as_py(), tag.as_py(), text.as_py())
                if sender.bytes >= SENDER_BYTES:
                    yield from rows()
        yield from rows()
        forget()

    return docs.select("doc_id", "tag", "text").mapInArrow(run, SENT)


def equal_windows(text: _Text, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort the windows that begin at the words ``at``; returns the order and where a new window begins in it.

    Windows are sorted by a 64-bit hash and neighbours of one hash compared
    byte by byte; should two different windows share a hash, all that share
    one are sorted by their bytes.
    """
    start, end, data = text.start[at], text.end[at + window - 1], text.data
    total = text.hashes(start, end)
    order = np.argsort(total)
    new = np.ones(len(order), bool)
    near = np.flatnonzero(total[order[1:]] == total[order[:-1]]) + 1
    spans = zip(*(x.tolist() for i in (order[near - 1], order[near]) for x in (start[i], end[i])))
    new[near] = [data[a:b] != data[c:d] for a, b, c, d in spans]
    if new[near].any():
        lists = [data[a:b] for a, b in zip(start.tolist(), end.tolist())]
        order = np.array(sorted(range(len(at)), key=lists.__getitem__))
        new[1:] = [lists[i] != lists[j] for i, j in zip(order[1:], order[:-1])]
    return order, new


FOUND = "doc_id long, tag long, first int, last int, often binary, body binary"


def _found(doc, tag, first, last) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": doc, "tag": tag, "first": first, "last": last, "often": None, "body": None})


def _runs(flagged: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of flagged neighbours of one group."""
    new = flagged.copy()
    new[1:] &= ~flagged[:-1] | (group[1:] != group[:-1])
    last = flagged.copy()
    last[:-1] &= ~flagged[1:] | (group[1:] != group[:-1])
    return np.flatnonzero(new), np.flatnonzero(last)


def judge(bodies: list[bytes]) -> Iterator[pd.DataFrame]:
    """One bucket: the window runs of documents that are not the first, and the minima of strings found often."""
    unpack = zstandard.ZstdDecompressor().decompress
    strings: list[bytes] = []
    counts, docs, tags, starts, low, high = [], [], [], [], [], []
    for body in bodies:
        data = unpack(body)
        n, places, size = struct.unpack_from("<III", data)
        at = 12 + size
        strings += data[12:at].split(b"\n")
        c = np.frombuffer(data, "<i4", n, at)
        at += 4 * n
        often = int((c == 0).sum())
        lo, hi = np.frombuffer(data, "<i8", often, at), np.frombuffer(data, "<i8", often, at + 8 * often)
        doc, tag, start = _places(data[at + 16 * often :], places)
        full = c > 0
        first, last = np.empty(n, np.int64), np.empty(n, np.int64)
        if places:
            cut = (np.cumsum(c) - c)[full]
            first[full], last[full] = np.minimum.reduceat(doc, cut), np.maximum.reduceat(doc, cut)
        first[~full], last[~full] = lo, hi
        for held, x in zip((counts, docs, tags, starts, low, high), (c, doc, tag, start, first, last)):
            held.append(x)
    counts, docs, tags, starts, low, high = map(np.concatenate, (counts, docs, tags, starts, low, high))
    text = _Text(b"\n".join(strings))
    n_windows = np.bincount(text.line, minlength=len(strings)) - WINDOW + 1
    of = np.repeat(np.arange(len(strings)), n_windows)
    base = np.cumsum(n_windows) - n_windows
    at = np.arange(len(of)) + (WINDOW - 1) * of  # words before: each earlier line has so many more than windows
    order, new = equal_windows(text, at)
    least = np.empty(len(of), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[of[order]], np.flatnonzero(new)), np.diff(np.r_[np.flatnonzero(new), len(of)]))
    touched = np.zeros(len(strings), bool)
    touched[of[least < high[of]]] = True
    # places: each window of a touched string against each of the string's documents
    mine = np.flatnonzero(touched & (counts > 0))
    begins = np.cumsum(counts) - counts
    for chunk in np.array_split(mine, max(1, int((counts[mine] * n_windows[mine]).sum() // 2_000_000) + 1)):
        if not len(chunk):
            continue
        spot = np.repeat(begins[chunk], counts[chunk]) + np.arange(counts[chunk].sum()) - np.repeat(np.cumsum(counts[chunk]) - counts[chunk], counts[chunk])
        owner = np.repeat(chunk, counts[chunk])
        yield _flag(docs[spot], tags[spot], starts[spot], n_windows[owner], base[owner], least)
    seen = set()
    for s in np.flatnonzero(counts == 0):
        if strings[s] not in seen:
            seen.add(strings[s])
            vector = least[base[s] : base[s] + n_windows[s]].astype("<i8").tobytes()
            yield pd.DataFrame({"doc_id": [None], "tag": [None], "first": [None], "last": [-1], "often": [xxhash.xxh128_digest(strings[s])], "body": [vector]}).astype({"doc_id": "Int64", "tag": "Int64", "first": "Int32"})


def _flag(doc, tag, start, n, base, least) -> pd.DataFrame:
    """Runs of windows whose smallest document lies before the place's own."""
    item = np.repeat(np.arange(len(doc)), n)
    step = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    first, last = _runs(least[base[item] + step] < doc[item], item)
    who = item[first]
    return _found(doc[who], tag[who], start[who] + step[first].astype(np.int32), start[who] + step[last].astype(np.int32))


def meet(sent: DataFrame) -> DataFrame:
    """Judge every bucket; places that were kept apart pass through."""
    dealt = sent.withColumn(
        "_to", F.when(F.col("often").isNull(), F.xxhash64("bucket")).otherwise(F.xxhash64("often", "body"))
    )
    dealt = dealt.repartition(F.col("_to")).sortWithinPartitions("often", "bucket").drop("_to")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, bucket = [], None
        for pdf in frames:
            apart = pdf["often"].notna()
            if apart.any():
                far = pdf[apart]
                none = pd.array([None] * len(far), "Int64")
                yield pd.DataFrame({"doc_id": none, "tag": none, "first": none.astype("Int32"), "last": none.astype("Int32"), "often": far["often"].to_numpy(), "body": far["body"].to_numpy()})
            for b, body in zip(pdf["bucket"][~apart], pdf["body"][~apart]):
                if b != bucket and held:
                    yield from judge(held)
                    held = []
                bucket = b
                held.append(body)
        if held:
            yield from judge(held)
        held = None
        forget()

    return dealt.mapInPandas(run, FOUND)


def _often_runs(found: DataFrame) -> DataFrame:
    """Runs in the places that were kept apart, from the minima of their strings."""
    apart = found.filter("often is not null and last is null").select("often", "body")
    minima = found.filter("often is not null and last = -1").select("often", F.col("body").alias("least"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for pdf in frames:
            for body, vector in zip(pdf["body"], pdf["least"]):
                data, least = unpack(body), np.frombuffer(vector, "<i8")
                n = struct.unpack_from("<I", data)[0]
                doc, tag, start = _places(data[4:], n)
                size, zero = np.full(n, len(least)), np.zeros(n, np.int64)
                yield _flag(doc, tag, start, size, zero, least)[["doc_id", "tag", "first", "last"]]

    return apart.join(minima, "often").mapInPandas(run, "doc_id long, tag long, first int, last int")


def repeated_runs(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """(doc_id, tag, first, last): runs of windows that also start in a document with a smaller id."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(64, 3 * size // BUCKET_BYTES)
    known = docs.filter("doc_id is not null and text is not null")
    found = written(meet(send(known, buckets, often)), "windows")
    release(docs.sparkSession)  # the strings' shuffle is the largest table of all and no longer needed
    near = found.filter("often is null").select("doc_id", "tag", "first", "last")
    return near.unionByName(_often_runs(found))


def remove_repeats(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """Add n_words, n_removed and ``kept`` (the words that stay, joined by one space) to each row.

    A NULL text has no words and NULL doc_ids neither lose words nor cause
    others to; equal doc_ids never affect each other, so repeated rows get the
    same result. Texts of one doc_id are told apart by a 64-bit hash. A long
    text is taken whole, one of fewer than 13 words loses nothing. An empty
    table gives no rows. Columns of ``docs`` with the names of the added ones
    are replaced; all others stay, whatever their names.
    """
    made = ("n_words", "n_removed", "kept")
    names = [c for c in docs.columns if c.lower() not in made]
    base = wrapped(docs, "text", without=made).withColumns(
        {"doc_id": F.col("row.doc_id").cast("long"), "tag": F.xxhash64("text")}
    )
    runs = (
        repeated_runs(base.select("doc_id", "tag", "text"), often)
        .groupBy("doc_id", "tag")
        .agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    )
    both = base.join(runs, ["doc_id", "tag"], "left")
    rows = both.select("row", "text", F.col("runs.first").alias("first"), F.col("runs.last").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, first, last in zip(*(batch.column(c) for c in ("text", "first", "last"))):
                w = words(text.as_py())
                edge = np.zeros(len(w) + 1, np.int32)
                if first.is_valid:
                    np.add.at(edge, np.array(first.values), 1)
                    np.add.at(edge, np.array(last.values) + WINDOW, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    stay = [x for x, g in zip(w, gone.tolist()) if not g]
                else:
                    stay = w
                n_words.append(len(w))
                n_removed.append(len(w) - len(stay))
                kept.append(b" ".join(stay).decode())
            columns = [batch.column("row"), batch.column("text")]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "text", *made])

    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]
    done = rows.mapInArrow(run, StructType([rows.schema["row"], rows.schema["text"], *added]))
    return done.select(*unwrapped(names, "text"), *made)


def removal_report(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text"), often).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )

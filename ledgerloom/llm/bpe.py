"""Byte-level BPE through a sentencepiece model that is written straight from the vocabulary.

Every byte has a printable character; a vocabulary entry becomes the piece of
its bytes' characters, scored by its negated rank, so that sentencepiece's
"best score first" merges in rank order. Normalisation is the identity. A
pre-token that is a vocabulary entry is that entry, as the rank-based encoder
has it; all others go through the merges.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .words import Packed, sliced


#: Pre-tokens that are looked up together, and the bytes of text that a worker takes from a batch at once.
TOKENS_AT_ONCE = 65_536
SLICE_BYTES = 1 << 20


def byte_characters() -> list[str]:
    """The character of each byte: itself where it is printable, else the next one from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


CHARS = byte_characters()
BYTES = {c: b for b, c in enumerate(CHARS)}
TO_CHARS = {b: c for b, c in enumerate(CHARS)}


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_CHARS)


def unmapped(piece: str) -> bytes:
    return bytes(BYTES[c] for c in piece)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes and the rank, a line each."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | str | bytes) -> bytes:
    """One protocol-buffer field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


NORMAL, UNKNOWN, BPE = 1, 2, 2


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model file; ids are ranks, the unknown piece follows them."""
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be gapless from 0")
    out = bytearray()
    for rank, token in enumerate(ordered):
        out += _field(1, _field(1, mapped(token)) + _field(2, float(-rank)) + _field(3, NORMAL))
    out += _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))
    size = len(ordered) + 1
    out += _field(2, _field(3, BPE) + _field(4, size) + _field(40, size - 1))
    out += _field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encoder and decoder of one vocabulary; built once per worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.find = regex.compile(pattern).finditer
        pack = struct.Struct("<I").pack
        whole = {token.decode(): pack(rank) for token, rank in ranks.items() if _text(token)}
        self.table = [unmapped(self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.known = Packed(always=whole)

    def _merged(self, tokens: list[str]) -> list[bytes]:
        ids = self.model.encode([mapped(t.encode()) for t in tokens], num_threads=1)
        return [array("I", found).tobytes() for found in ids]

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian 32-bit integers; None counts as empty."""
        out, known = bytearray(), self.known
        found = (m[0] for m in self.find(text or ""))
        while some := list(islice(found, TOKENS_AT_ONCE)):
            known.room()
            parts = list(map(known.get, some))
            if None in parts:
                missing = list({t for t, p in zip(some, parts) if p is None})
                known.learn(dict(zip(missing, self._merged(missing))))
                parts = map(known.__getitem__, some)
            out += b"".join(parts)
        return bytes(out)

    def decode(self, ids: bytes) -> bytes:
        table, out = self.table, bytearray()
        for at in range(0, len(ids), 4 * TOKENS_AT_ONCE):
            out += b"".join(map(table.__getitem__, memoryview(ids)[at : at + 4 * TOKENS_AT_ONCE].cast("I")))
        return bytes(out)


def _text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


@cache
def pieces(path: str) -> list[bytes]:
    """The bytes of each id, by the inverse mapping of its piece; no model is needed for it."""
    ranks = read_ranks(path)
    return [unmapped(mapped(token)) for token in sorted(ranks, key=ranks.__getitem__)]


def _with_columns(df: DataFrame, read: str, made: dict[str, tuple[str, pa.DataType]], work) -> DataFrame:
    """Add columns that ``work`` makes of single values of ``read``; others of their names are replaced."""
    rest = df.drop(*made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, read, SLICE_BYTES):
                rows = [work(x.as_py()) for x in part.column(read)]
                columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(made.values())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *made])

    ddl = [f"`{c}` {t}" for c, t in rest.dtypes] + [f"`{c}` {t}" for c, (t, _) in made.items()]
    return rest.mapInArrow(run, ", ".join(ddl))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids of the whole text, packed as little-endian unsigned 32-bit integers.

    NULL and empty texts give no ids. Rows stay as they are, repeated ones too;
    an extra column called like ``out`` is replaced. No row depends on another,
    so there is no shuffle, and a lost task is simply run again. A long text
    goes through in runs of TOKENS_AT_ONCE pre-tokens; an empty table gives no
    rows.
    """
    return _with_columns(docs, text, {out: ("binary", pa.binary())}, lambda t: (codec(path, pattern).encode(t),))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the packed ids stand for. NULL ids give NULL.

    Repeated rows come out alike, no ids give no bytes, an empty table gives no
    rows, a column called like ``out`` is replaced.
    """

    def work(packed: bytes | None) -> tuple[bytes | None]:
        table = pieces(path)
        return (None if packed is None else b"".join(map(table.__getitem__, memoryview(packed).cast("I"))),)

    return _with_columns(rows, ids, {out: ("binary", pa.binary())}, work)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to.

    Encoding, decoding and both digests happen in one worker, row by row, so
    neither ids nor decoded bytes are kept beside the text. NULL texts count
    as empty, repeated rows come out as often as they came in, an empty table
    gives no rows; other columns take no part.
    """

    def work(text: str | None) -> tuple[int, str, str]:
        c = codec(path, pattern)
        ids = c.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    made = {"n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _with_columns(docs.select("doc_id", "text"), "text", made, work).drop("text")

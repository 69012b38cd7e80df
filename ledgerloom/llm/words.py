"""Words as every contract here defines them: runs of anything but ASCII white space."""

from __future__ import annotations

import ctypes
import weakref

import pyarrow as pa

#: The characters between words.
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """The words in UTF-8; ``bytes.split`` parts at just these six characters."""
    return text.encode().split() if text else []


#: The maps of this worker.
_maps: list[weakref.ref] = []


def forget() -> None:
    """Empty the maps of this worker and give unused memory back to the system.

    Spark hands a worker from one operator to the next, and keeps it for a
    while without work; what it still held would stand beside the memory that
    the JVM needs meanwhile.
    """
    for held in [m() for m in _maps]:
        if held is not None and held.size:
            held.empty()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


class Packed(dict):
    """A map from word to packed ids that :meth:`room` empties when it has taken ``limit`` bytes, so memory stays bounded; ``always`` stays."""

    def __init__(self, limit: int = 64_000_000, always: dict | None = None):
        super().__init__(always or {})
        self.limit, self.size, self.always = limit, 0, always or {}
        _maps.append(weakref.ref(self))

    def room(self) -> None:
        if self.size > self.limit:
            self.empty()

    def empty(self) -> None:
        self.clear()
        self.update(self.always)
        self.size = 0

    def learn(self, found: dict) -> None:
        self.update(found)
        self.size += sum(240 + 4 * len(w) + len(ids) for w, ids in found.items())  # two objects and a place, at most


def sliced(batch: pa.RecordBatch, text: str, most_bytes: int = 8_000_000):
    """Parts of a batch with about so many bytes of text each; a longer text comes alone."""
    size = batch.column(text).nbytes
    step = max(1, int(batch.num_rows * most_bytes / max(size, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)

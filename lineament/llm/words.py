"""Words of whole Arrow columns as arrays: byte spans and 64-bit names.

A batch's texts lie end to end in one UTF-8 buffer.  Word bounds come from a
byte class table.  A word's name takes its bytes eight at a time, each eight
mixed into what came before, so no Python object is made for a word; only words
of over LONG bytes are hashed one by one.  Names decide what may be equal.
Where a result rests on equality across texts, digests of the bytes or the words
themselves decide.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text bytes handled at a time, if a single text isn't longer.
STEP = 1 << 18
#: What an Arrow batch to Python may hold.
BATCH_BYTES = 1 << 20

#: Bytes beyond which a span is named by a cryptographic hash.
LONG = 256

_u = np.uint64
_LENGTH, _JOIN = _u(0x9E3779B97F4A7C15), _u(0xD1342543DE82EF95)
#: What keeps the first n bytes of eight, read with the first byte lowest.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Everything below 0x80 but digits and lower-case letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0, 48), *range(58, 97), *range(123, 128)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits; a bijection."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _u(32))
        x = x * _u(0xD6E8FEB86659FD93)
        x = x ^ (x >> _u(32))
        x = x * _u(0xD6E8FEB86659FD93)
        return x ^ (x >> _u(32))


def span_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name for each span [start, end) of bytes."""
    size = end - start
    eights = np.ndarray((len(data) + 1,), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,)).astype(np.uint64)
    with np.errstate(over="ignore"):
        name = mix(eights[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _LENGTH
        on = np.flatnonzero((size > 8) & (size <= LONG))
        at = 8
        while len(on):
            name[on] = mix(mix(name[on]) + (eights[start[on] + at] & _FIRST[np.minimum(size[on] - at, 8)]))
            at += 8
            on = on[size[on] > at]
    body = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > LONG).tolist():
        name[i] = int.from_bytes(blake2b(body[int(start[i]) : int(end[i])], digest_size=8).digest(), "little")
    return mix(name)


def joined_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of two things side by side."""
    with np.errstate(over="ignore"):
        return mix(a + mix(b ^ _JOIN))


def gram_names(names: np.ndarray, n: int) -> np.ndarray:
    """The name of the n values from each place on at which n are left, joined from those of runs of 1, 2, 4, ... values."""
    many = max(len(names) - n + 1, 0)
    out, at, width, power = None, 0, 1, names
    while True:
        if n & width:
            part = power[at : at + many]
            out = part if out is None else joined_names(out, part)
            at += width
        if 2 * width > n:
            return out
        power = joined_names(power[:-width], power[width:]) if len(power) > width else power[:0]
        width *= 2


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, at, data = column.buffers()
    if n == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return body, off - off[0]


def bounded(df: DataFrame) -> DataFrame:
    """df, its session sending Python no more than BATCH_BYTES of a table's rows at a time (or one row)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def unused(df: DataFrame, name: str) -> str:
    """A column name made from name that df hasn't, in any case."""
    taken = {c.lower() for c in df.columns}
    name = "__" + name
    while name.lower() in taken:
        name += "_"
    return name


def trim() -> None:
    """Gives memory that a task has freed back to the system; its worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about STEP text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        cut = np.cumsum(sizes, dtype=np.int64) // STEP
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
    trim()


class Words:
    """Word spans of a batch: bytes [start, end), rows' words at [at[i], at[i + 1])."""

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACE, lower: bool = False):
        self.data, self.off = utf8(column)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = ~separators[self.data]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = self.off[(self.off > 0) & (self.off < n)]
            first[edge] |= inside[edge]
            last[edge - 1] |= inside[edge - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.at)
        self.inside = inside

    def names(self) -> np.ndarray:
        """A 64-bit name for each word."""
        return span_names(self.data, self.start, self.end)

    def digests(self) -> list[bytes]:
        """By row, 128 bits that stand for its words: a hash of their bytes and lengths."""
        body = memoryview(np.ascontiguousarray(self.data[self.inside]))
        off = np.concatenate([[0], np.cumsum(self.inside)])[self.off].tolist()
        sizes = memoryview((self.end - self.start).astype("<u4"))
        at, out = self.at.tolist(), []
        for i in range(len(at) - 1):
            h = blake2b(body[off[i] : off[i + 1]], digest_size=16)
            h.update(sizes[at[i] : at[i + 1]])
            out.append(h.digest())
        return out

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends): all words, each followed by one space, and where each lies in the bytes."""
        size = self.end - self.start
        end = np.cumsum(size + 1) - 1
        body = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
        place = np.ones(len(body), bool)
        place[end] = False
        body[place] = self.data[self.inside]
        return body, end - size, end

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def kept(self, row: int, keep: np.ndarray | None = None) -> bytes:
        """A row's words, or those with keep, joined by one space."""
        body = self.data[self.off[row] : self.off[row + 1]].tobytes().split()
        return b" ".join(body if keep is None else [w for w, k in zip(body, keep.tolist()) if k])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)

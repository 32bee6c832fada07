"""Keyed entries that travel as packed arrays, and groups of them that a task meets piece by piece.

An entry is (name, owner, payload, check): 64-bit columns.  check, a second half
of the name, is zero where a name needs no more than 64 bits.  A batch's entries
are dealt to parts by name and each part's are one binary row, so the shuffle
moves 16 to 32 bytes an entry.  A task doesn't hold a name's whole group: it keeps
what is still undecided about each name and passes on the rest as it comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lineament.llm.words import trim
from lineament.plans.storage import partitions

#: Entries held before they are dealt out, or merged into what is known.
HELD = 200_000
SHAPE = "pid long, undecided binary, decided binary"
_u = np.uint64


class Entries:
    __slots__ = ("name", "owner", "payload", "check", "known")

    def __init__(self, name, owner, payload=None, check=None, known=None):
        self.name, self.owner = name, owner
        self.payload = np.zeros(len(name), np.int64) if payload is None else payload
        self.check = np.zeros(len(name), np.uint64) if check is None else check
        self.known = np.zeros(len(name), bool) if known is None else known

    def take(self, at) -> "Entries":
        return Entries(*(getattr(self, k)[at] for k in Entries.__slots__))

    def __len__(self) -> int:
        return len(self.name)

    def packed(self) -> bytes:
        """Eight bytes that say how many entries and which columns are all zero, then the columns."""
        columns = [self.name, self.owner, self.payload, self.check, np.packbits(self.known)]
        full = [c.any() for c in columns]
        head = (len(self) << 8 | sum(1 << i for i, f in enumerate(full) if f)).to_bytes(8, "little")
        return b"".join([head, *(c.tobytes() for c, f in zip(columns, full) if f)])

    @staticmethod
    def unpacked(raw: bytes) -> "Entries":
        head, at = int.from_bytes(raw[:8], "little"), 8
        n, columns = head >> 8, []
        for i, kind in enumerate((np.uint64, np.int64, np.int64, np.uint64, np.uint8)):
            count = n if i < 4 else -(-n // 8)
            if head >> i & 1:
                columns.append(np.frombuffer(raw, kind, count, at))
                at += columns[-1].nbytes
            else:
                columns.append(np.zeros(count, kind))
        return Entries(*columns[:4], np.unpackbits(columns[4], count=n).astype(bool))


def joined(parts: list[Entries]) -> Entries:
    return Entries(*(np.concatenate([getattr(p, k) for p in parts]) for k in Entries.__slots__))


def groups(e: Entries) -> tuple[Entries, np.ndarray, np.ndarray]:
    """Sorted by name and owner, without entries like the one before; the first of each name; the group of each."""
    checked = e.check.any()
    e = e.take(np.lexsort((e.owner, e.check, e.name) if checked else (e.owner, e.name)))
    if not len(e):
        return e, np.zeros(0, int), np.zeros(0, int)
    fresh = (e.name[1:] != e.name[:-1]) | (e.check[1:] != e.check[:-1])
    like = ~fresh & (e.owner[1:] == e.owner[:-1]) & (e.payload[1:] == e.payload[:-1]) & (e.known[1:] == e.known[:-1])
    if like.any():
        at = np.append(True, ~like)
        e, fresh = e.take(np.flatnonzero(at)), fresh[at[1:]]
    first = np.flatnonzero(np.append(True, fresh))
    sizes = np.diff(np.append(first, len(e)))
    return e, first, np.repeat(np.arange(len(first)), sizes)


def shared(e: Entries) -> tuple[Entries, Entries]:
    """(decided, undecided): all entries of names with two owners; one entry stands for each name.

    A standing entry whose name is known to be shared has known set; it has been passed on already.
    """
    e, first, of = groups(e)
    if not len(e):
        return e, e
    last = np.append(first[1:], len(e)) - 1
    both = (e.owner[first] != e.owner[last]) | np.logical_or.reduceat(e.known, first)
    out = e.take(np.flatnonzero(both[of] & ~e.known))
    one_owner = ~both[of]
    stands = one_owner.copy()
    stands[first] = True
    rest = e.take(np.flatnonzero(stands))
    rest.known = ~one_owner[np.flatnonzero(stands)]
    return out, rest


def later(e: Entries) -> tuple[Entries, Entries]:
    """(decided, undecided): entries whose name has one of a smaller owner; those of the least owner."""
    e, first, of = groups(e)
    if not len(e):
        return e, e
    least = e.owner == e.owner[first][of]
    return e.take(np.flatnonzero(~least)), e.take(np.flatnonzero(least))


Rule = Callable[[Entries], tuple[Entries, Entries]]


def bundles(e: Entries, rule: Rule, parts: int) -> pa.RecordBatch:
    """A batch's entries, one row a part; what the batch decides alone goes beside them."""
    decided, e = rule(e)
    pid = (e.name % _u(parts)).astype(np.int64)
    order = np.argsort(pid, kind="stable")
    e, pid = e.take(order), pid[order]
    cut = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]])) if len(pid) else np.zeros(0, int)
    ends = [*cut[1:].tolist(), len(pid)] if len(pid) else []
    rows = [pid[cut].tolist(), [e.take(slice(i, j)).packed() for i, j in zip(cut.tolist(), ends)], [b""] * len(cut)]
    if len(decided):
        rows = [r + [x] for r, x in zip(rows, (int(decided.name[0] % _u(parts)), b"", decided.packed()))]
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["pid", "undecided", "decided"])


def parts_of(spark: SparkSession) -> int:
    """Parts that names are dealt to; several go to a task, so that tasks get alike."""
    return 16 * partitions(spark)


def dealt(batches: Iterator[Entries], rule: Rule, parts: int) -> Iterator[pa.RecordBatch]:
    """bundles() of a task's entries, HELD at a time."""
    held, n = [], 0
    for e in batches:
        held.append(e)
        n += len(e)
        if n >= HELD:
            yield bundles(joined(held), rule, parts)
            held, n = [], 0
    if held:
        yield bundles(joined(held), rule, parts)
    held = []
    trim()


def decided(df: DataFrame, rule: Rule, give: Callable[[Entries], pa.RecordBatch], shape: str, tasks: int = 4) -> DataFrame:
    """Bundles met part by part; give() turns decided entries into rows of shape.

    tasks is how many tasks there are for each shuffle partition: more of them
    hold less, fewer give longer rows where give() makes one for each owner.
    """

    def run(batches):
        state, held, n = [], [], 0
        done, m = [], 0

        def merge() -> Entries:
            nonlocal state, held, n
            out, rest = rule(joined(state + held))
            state, held, n = [rest], [], 0
            return out

        def given():
            nonlocal done, m
            out, done, m = joined(done), [], 0
            return give(out)

        for b in batches:
            for raw, known in zip(b.column("undecided").to_pylist(), b.column("decided").to_pylist()):
                out = Entries.unpacked(known) if known else None
                if raw:
                    held.append(Entries.unpacked(raw))
                    n += len(held[-1])
                    if n >= max(HELD, len(state[0]) if state else 0):
                        out = joined([merge(), *([out] if out else [])])
                if out is not None and len(out):
                    done.append(out)
                    m += len(out)
                if m >= 5 * HELD:
                    yield given()
        if held and len(out := merge()):
            done.append(out)
        if done:
            yield given()
        state, held, done = [], [], []
        trim()

    return df.repartition(tasks * partitions(df.sparkSession), "pid").mapInArrow(run, shape)

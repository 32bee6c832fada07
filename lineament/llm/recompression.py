"""Repeated passages by recompression.

Each round names what stands side by side, for all texts alike: the first names
runs of one token, every later one names pairs whose left symbol falls in the
round's left half of all symbols and whose right symbol falls in the other.  A
name is a hash of what it is made of, so no round needs to agree on a table: two
equal substrings get the same symbols but for a few at their ends.  How many is
known from the substring alone: a symbol at its left end is safe if no symbol
before it could take it into a pair, and likewise at its right end.

A window of words is named by the first safe symbol of the last round in which
it has one.  Equal windows are named alike, so only windows whose symbol occurs
in two different texts can repeat.  Those are met again under a 128-bit
cryptographic digest of their words, which stands for the words themselves.
Windows that share their symbol at one place travel as one entry.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineament.llm.packed import SHAPE, Entries, dealt, decided, later, parts_of, shared
from lineament.llm.signature_tree import node
from lineament.llm.words import Words, bounded, mix, pieces
from lineament.plans.storage import sized, written

WINDOW, ROUNDS = 50, 12
#: Low bits of a payload: a range's windows, or some bits of the text's digest.
TAG = 24
MASK = (1 << TAG) - 1
_u = np.uint64


def window_symbols(names: np.ndarray, at: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, symbol, place) of every window: its first word, its symbol's name, and the word where the symbol starts."""
    count = np.maximum(np.diff(at) - window + 1, 0)
    start = np.arange(count.sum()) + np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    symbol, place = np.zeros(len(start), np.uint64), start.copy()
    if not len(start):
        return start, symbol, place
    sym, where = names, np.arange(len(names) + 1)
    row_start = np.zeros(len(names) + 1, bool)
    row_start[at] = True
    alive, left, right = np.arange(len(start)), start.copy(), start + window
    for r in range(rounds + 1):
        n = len(sym)
        keep = np.ones(n + 1, bool)
        if r == 0:  # runs
            keep[1:n] = (sym[1:] != sym[:-1]) | row_start[1:n]
            new = np.cumsum(keep) - 1
            first = np.flatnonzero(keep)
            size = np.diff(first)
            fresh = sym[first[:-1]]
            fresh = np.where(size > 1, mix(fresh + mix(size.astype(np.uint64))), fresh)
            l2, r2 = new[left] + 1, new[right - 1]
        else:  # pairs
            high = (mix(sym ^ mix(_u(r))) >> _u(63)).astype(bool)
            second = np.zeros(n + 1, bool)
            second[1:n] = ~high[:-1] & high[1:] & ~row_start[1:n]
            keep = ~second
            new = np.cumsum(keep) - 1
            first = np.flatnonzero(keep)
            fresh = sym[first[:-1]]
            two = np.diff(first) == 2
            fresh[two] = mix(mix(fresh[two] + _u(r)) + sym[first[:-1][two] + 1])
            l2, r2 = new[left + high[left]], new[right - ~high[right - 1]]
        safe = l2 < r2
        done = alive[~safe]
        symbol[done], place[done] = mix(sym[left[~safe]] + _u(r)), where[left[~safe]]
        sym, where, row_start = fresh, where[first], row_start[first]
        alive, left, right = alive[safe], l2[safe], r2[safe]
        if not len(alive):
            return start, symbol, place
    symbol[alive], place[alive] = mix(sym[left] + _u(rounds + 1)), where[left]
    return start, symbol, place


TEXT = "doc_id long, n_words long, sha string, digest binary, node long"


def _texts(batches):
    for b in pieces(batches):
        w = Words(b.column("text"))
        keys = w.digests()
        shas = [sha256(w.kept(i)).hexdigest() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(w.count, pa.int64()), pa.array(shas), pa.array(keys, pa.binary()), pa.array([node(k) for k in keys], pa.int64())], names=["doc_id", "n_words", "sha", "digest", "node"]
        )


def _symbols(window: int, parts: int):
    def entries(batches):
        for b in pieces(batches):
            w = Words(b.column("text"))
            names, at = w.names(), w.at
            start, symbol, place = window_symbols(names, at, window)
            row = np.searchsorted(at, start, side="right") - 1
            keys = np.array([node(k) for k in w.digests()], np.int64)
            if not len(start):
                continue
            lead = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1])]))
            size = np.diff(np.append(lead, len(start)))
            payload = ((start[lead] - at[row[lead]]) << TAG) | size  # windows that hold one symbol are fewer than a window's words
            yield Entries(symbol[lead], keys[row[lead]], payload)

    return lambda batches: dealt(entries(batches), shared, parts)


def _gathered(e: Entries, owner: str, payloads: str) -> pa.RecordBatch:
    """A row an owner, with its payloads as one binary."""
    e = e.take(np.lexsort((e.payload, e.owner)))
    cut = np.flatnonzero(np.concatenate([[True], e.owner[1:] != e.owner[:-1]])).tolist()
    ends = [*cut[1:], len(e)]
    return pa.RecordBatch.from_arrays([pa.array(e.owner[cut]), pa.array([e.payload[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())], names=[owner, payloads])


def _windows(window: int, parts: int):
    """Entries of the windows within a row's ranges: (128 bits for the window's words, doc_id, place and some bits of the text's digest)."""

    def entries(batches):
        for b in pieces(batches):
            w = Words(b.column("text"))
            at = w.at.tolist()
            starts, rows, tags = [], [], []
            for i, (d, k, ranges) in enumerate(zip(b.column("digest").to_pylist(), w.digests(), b.column("ranges").to_pylist())):
                if d != k:
                    continue
                x = np.frombuffer(b"".join(ranges), np.int64)
                first, size = x >> TAG, x & MASK
                s = np.unique(np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()))
                starts.append(s + at[i])
                rows.append(np.full(len(s), i))
                tags.append(np.full(len(s), node(d) & MASK))
            if not starts:
                continue
            s, row = np.concatenate(starts), np.concatenate(rows)
            body, begin, end = w.spaced()
            body = memoryview(body)
            key = np.frombuffer(b"".join([blake2b(body[i:j], digest_size=16).digest() for i, j in zip(begin[s].tolist(), end[s + window - 1].tolist())]), np.uint64)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            yield Entries(key[::2], ids[row], ((s - np.array(at)[row]) << TAG) | np.concatenate(tags), key[1::2])

    return lambda batches: dealt(entries(batches), later, parts)


def _kept(window: int):
    def run(batches):
        for b in pieces(batches):
            w = Words(b.column("text"))
            at = w.at.tolist()
            ids, keys, removed, shas = [], [], [], []
            for i, (doc, d, k, places) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist(), w.digests(), b.column("places").to_pylist())):
                n = at[i + 1] - at[i]
                if d != k:
                    continue
                step = np.zeros(n + 1, np.int64)
                x = np.frombuffer(b"".join(places), np.int64)
                s = np.unique(x[(x & MASK) == (node(d) & MASK)] >> TAG)
                np.add.at(step, s, 1)
                np.add.at(step, s + window, -1)
                keep = np.cumsum(step)[:n] == 0
                ids.append(doc)
                keys.append(d)
                removed.append(int(n - keep.sum()))
                shas.append(sha256(w.kept(i, keep)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "digest", "removed", "kept"])

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text, ...).

    A word goes if a window of `window` words that covers it also starts in a
    row with a smaller doc_id.  Windows are those of the input.  Texts with the
    same words are one class: all but the class's least doc_id lose every word,
    if they have a window at all, and only the least is compared with others.
    A null text has no words.  A row with a null doc_id keeps its words and
    takes them from no other.  Rows that repeat a doc_id don't take words from
    one another.  Further columns aren't read; an empty table gives no rows.
    """
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = parts_of(docs.sparkSession)
    texts = written(docs.mapInArrow(_texts, TEXT), "texts")
    long = texts.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    firsts = written(long.groupBy("digest", "node").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("other")), "firsts")
    met = docs.filter("doc_id is not null").mapInArrow(_symbols(window, parts), SHAPE)
    ranges = decided(met, shared, lambda e: _gathered(e, "node", "ranges"), "node long, ranges binary").groupBy("node").agg(F.collect_list("ranges").alias("ranges"))
    wanted = written(ranges.join(firsts.select("node", "digest", F.col("first").alias("doc_id")), "node").select("doc_id", "digest", "ranges"), "ranges")
    # the texts are shuffled once; only those with a shared symbol go on
    held = written(docs.join(wanted, "doc_id"), "held")
    windows = held.mapInArrow(_windows(window, parts), SHAPE)
    places = decided(windows, later, lambda e: _gathered(e, "doc_id", "places"), "doc_id long, places binary", tasks=1).groupBy("doc_id").agg(F.collect_list("places").alias("places"))
    cut = written(held.drop("ranges").join(places, "doc_id").mapInArrow(_kept(window), "doc_id long, digest binary, removed long, kept string").distinct(), "cut")
    copies = firsts.filter("other > first").select("digest", "first")
    out = texts.join(sized(copies, 48), "digest", "left").join(sized(cut, 200), ["doc_id", "digest"], "left")
    whole = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window)
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )

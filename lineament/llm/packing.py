"""Packing by non-negative least squares.

Every text is tokenised, ended by one id, and cut into full windows and a
remainder.  The remainders' lengths make a histogram of at most `window` bins.
Combinations of up to three lengths that fill a window (or a smaller power of
two, which needs no padding either) are the columns of a least-squares problem
whose non-negative solution says how often to repeat each; it is rounded, and
what the histogram has left is packed greedily, largest lengths first.

Pieces of a length are numbered and the repeats take them by number, so nothing
but the histogram and the plan, both bounded by the window, passes the driver.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineament.llm.words import bounded, pieces
from lineament.plans.storage import partitions, written

WINDOW, END_ID = 1024, 0
#: Distinct space-separated chunks whose ids a task keeps.
CHUNKS = 600_000
_SINGLE_SPACE = re.compile(r" (?=\S)")


class _Spaces(Exception):
    pass


class Encoder:
    """Ids, as little-endian 32-bit values, of whole texts under a byte-level BPE file of tokenizers.

    The file's own rules are followed: a space joins what follows it, so a text
    can be taken apart at single spaces and each distinct chunk encoded once.
    Chunks go through a rank-based encoder over the same vocabulary, which gives
    the same ids (tests hold it against tokenizers itself).
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        # fixed value: the pattern of byte-level BPE
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.coder = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = [*special]
        self.cache = self._Cache(self)

    def direct(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.coder.encode(text, allowed_special="all")).tobytes()
        return array("I", self.coder.encode_ordinary(text)).tobytes()

    class _Cache(dict):
        def __init__(self, encoder: "Encoder"):
            self.encoder = encoder

        def __missing__(self, chunk: str) -> bytes:
            if not chunk or chunk[0].isspace():
                raise _Spaces
            out = self[chunk] = self.encoder.direct(" " + chunk)
            return out

    def encode(self, text: str) -> bytes:
        if len(self.cache) > CHUNKS:
            self.cache.clear()
        first, *rest = text.split(" ")
        try:
            return b"".join([self.direct(first) if first else b"", *map(self.cache.__getitem__, rest)])
        except _Spaces:
            first, *rest = _SINGLE_SPACE.split(text)
            known = self.cache
            return b"".join([self.direct(first) if first else b"", *(known[c] if c in known else self.direct(" " + c) for c in rest)])


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str, window: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        encoder, end = Encoder(path), array("I", [end_id]).tobytes()
        for b in pieces(batches):
            docs, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                raw = memoryview(encoder.encode(text or "") + end)
                n = len(raw) // 4
                for s in range(0, n, window):
                    e = min(s + window, n)
                    docs.append(doc)
                    starts.append(s)
                    lengths.append(e - s)
                    crcs.append(zlib.crc32(raw[4 * s : 4 * e]))
                    totals.append(n)
                    if keep_ids:
                        ids.append(np.frombuffer(raw[4 * s : 4 * e], np.int32))
            columns = [pa.array(x, pa.int64()) for x in (docs, starts, lengths, crcs, totals)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def combinations(have: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) with have > 0 that fill the window, or two or one that fill a power of two."""
    lengths = np.flatnonzero(have[: window + 1])
    lengths = lengths[lengths > 0]
    present = np.zeros(2 * window + 2, bool)
    present[lengths] = True
    out = []
    full, powers = window, [1 << k for k in range(window.bit_length())]
    for target in {full, *(p for p in powers if p <= window)}:
        if present[target]:
            out.append(np.array([[target, 0, 0]]))
        a = lengths[lengths * 2 <= target]
        b = target - a
        ok = present[b] & (b >= a)
        out.append(np.stack([a[ok], b[ok], np.zeros(ok.sum(), int)], 1))
    for a in lengths[lengths * 3 <= full]:
        b = lengths[(lengths >= a) & (2 * lengths <= full - a)]
        c = full - a - b
        b, c = b[present[c]], c[present[c]]
        out.append(np.stack([np.full(len(b), a), b, c], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 near the least |A x - target|, A having a 1 for each length of a row of columns; accelerated projected gradient."""
    if not len(columns):
        return np.zeros(0)
    weight = (columns > 0).astype(float)
    counts = np.bincount(columns.ravel(), weights=weight.ravel(), minlength=len(target))
    x = y = np.zeros(len(columns))
    # the largest eigenvalue of A'A is at most the largest row sum of A times the longest column
    step, t = 1.0 / (3 * max(counts.max(), 1.0)), 1.0
    for _ in range(rounds):
        fit = np.bincount(columns.ravel(), weights=(weight * y[:, None]).ravel(), minlength=len(target)) - target
        new = np.maximum(0, y - step * (fit[columns] * weight).sum(1))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: dict[int, int], window: int) -> list[tuple[list[int], int]]:
    """(lengths, repeats): together they use the histogram up."""
    left = np.zeros(window + 1, np.int64)
    for n, c in histogram.items():
        left[n] += c
    out = []
    if left[window]:
        out.append(([window], int(left[window])))
        left[window] = 0
    rows = combinations(left, window)
    x = np.rint(nnls(rows, left.astype(float))).astype(np.int64)
    for k in np.argsort(-x, kind="stable"):
        if x[k] <= 0:
            break
        lengths = [int(n) for n in rows[k] if n]
        times = min(int(x[k]), *(int(left[n]) // lengths.count(n) for n in lengths))
        if times:
            out.append((lengths, times))
            for n in lengths:
                left[n] -= times
    while left.any():
        lengths, gap, rest = [], window, left.copy()
        while gap:
            fits = np.flatnonzero(rest[: gap + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            lengths.append(n)
            rest[n] -= 1
            gap -= n
        times = min(int(left[n]) // lengths.count(n) for n in set(lengths))
        out.append((lengths, times))
        for n in lengths:
            left[n] -= times
    return out


def slots(patterns: list[tuple[list[int], int]], window: int) -> tuple[np.ndarray, ...]:
    """(key, first sequence, offset) by key = length * 2**48 + first number; a piece takes the last key not above its own."""
    taken, rows, base = [0] * (window + 1), [], 0
    for lengths, times in patterns:
        at = 0
        for n in lengths:
            rows.append(((n << 48) + taken[n], base, at))
            taken[n] += times
            at += n
        base += times
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))


def _placed(table, names: list[str]):
    def run(batches):
        key, base, offset = table.value
        for b in batches:
            own = (b.column("length").to_numpy().astype(np.int64) << 48) + b.column("__number").to_numpy()
            k = np.searchsorted(key, own, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(base[k] + own - key[k]), pa.array(offset[k])], names=[*names, "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece; ids with keep_ids.

    Each row of docs (doc_id, text, ...) is tokenised whole and ended by end_id;
    a null text is empty.  Each id lies in one piece, pieces of a sequence follow
    one another without gaps from offset 0 and take no more than the window.
    Rows that repeat a doc_id are packed each for itself.  An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = written(docs.mapInArrow(_cut(tokenizer, window, end_id, keep_ids), PIECE + (", ids array<int>" if keep_ids else "")), "pieces")
    by_bucket = 8 * partitions(spark)
    cut = cut.withColumn("__bucket", F.expr(f"pmod(xxhash64(doc_id, start, ids_crc32), {by_bucket})"))
    counts = written(cut.groupBy("__bucket", "length").agg(F.count("*").alias("__n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most `window` rows
    table = spark.sparkContext.broadcast(slots(plan(histogram, window), window))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__bucket", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    number = F.row_number().over(Window.partitionBy("__bucket", "length").orderBy("doc_id", "start", "ids_crc32"))
    numbered = cut.withColumn("__row", number).join(bases, ["__bucket", "length"])
    names = [n for n in cut.columns if n != "__bucket"]
    shape = cut.drop("__bucket").schema.add("sequence_id", "long").add("offset", "long")
    return numbered.select(*names, (F.col("__base") + F.col("__row") - 1).alias("__number")).mapInArrow(_placed(table, names), shape)

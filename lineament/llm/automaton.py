"""Benchmark decontamination by a generalised suffix automaton.

The normalised items' words are numbered and one suffix automaton is built over
all items.  A document's words stream through it; the state and the length of
the longest match at each word say which windows of the items end there.  Only
stretches whose neighbouring words stand side by side in some item can hold a
window, so the automaton runs over those alone.

The items are cut into blocks of about BLOCK_WORDS words.  A block is sent to
all tasks, which build its automaton; with several blocks each meets all rows in
a pass of its own and the passes' hits are united, so the benchmark may be of
any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineament.llm.words import LOWER, NOT_ALNUM, Words, bounded, pieces, unused
from lineament.plans.storage import sized, written

WINDOW = 8
#: Words of the items of one block; some 500 bytes of automaton a word.
BLOCK_WORDS = 200_000
_TO_SPACE = bytes(32 if NOT_ALNUM[LOWER[i]] else int(LOWER[i]) for i in range(256))


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_SPACE).split()


class Automaton:
    """Suffix automaton of several word sequences; items are told apart by their place in the list."""

    def __init__(self, items: list[list[int]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window, self.n = window, len(items)
        owners: list[set[int]] = [set()]
        short: dict[int, list[tuple[int, int]]] = {}
        ends = []
        for k, seq in enumerate(items):
            last = 0
            for c in seq:
                last = self._extend(last, c)
            ends.append(last)
        owners = [set() for _ in self.next]
        for k, seq in enumerate(items):
            v = 0
            for c in seq:
                v = self.next[v][c]
                owners[v].add(k)
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            owners[self.link[v]] |= owners[v]
        #: By state: the items that have the window ending there, if the match is as long as a window.
        self.at_window: list[frozenset[int] | None] = [None] * len(self.next)
        #: By state: short items that end with the match, as (length, item).
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for k, seq in enumerate(items):
            if 0 < len(seq) < window:
                v = 0
                for c in seq:
                    v = self.next[v][c]
                short.setdefault(v, []).append((len(seq), k))
        for v in sorted(range(1, len(self.next)), key=lambda v: self.length[v]):
            up = self.link[v]
            self.short[v] = self.short[up] + tuple(short.get(v, ()))
            if self.length[v] >= window:
                self.at_window[v] = self.at_window[up] if self.length[up] >= window else frozenset(owners[v])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def stream(self, words: list[int]):
        """(end, length, items) of each window or short item that ends at a word, longest first."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        v = l = 0
        for i, c in enumerate(words):
            while c not in nxt[v]:
                v = link[v]
                if v < 0:
                    break
                l = length[v]
            if v < 0:
                v = l = 0
                continue
            v = nxt[v][c]
            l += 1
            if l >= window:
                yield i, window, self.at_window[v]
            for n, k in self.short[v]:
                if n <= l:
                    yield i, n, (k,)


class Block:
    """A block of items with what finds the stretches worth streaming."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        seqs = [item_words(t) for t in texts]
        self.ids = ids
        words = sorted({w for s in seqs for w in s})
        number = {w: i for i, w in enumerate(words)}
        items = [[number[w] for w in s] for s in seqs]
        self.automaton = Automaton(items, window)
        names = Words(pa.array([w.decode() for w in words], pa.string()), NOT_ALNUM).names()
        order = np.argsort(names)
        self.names, self.number = names[order], order
        self.words, self.total = words, len(words)
        pairs = {a * self.total + b for s in items for a, b in zip(s, s[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        lengths = [min(len(s), window) for s in items if s]
        self.least = min(lengths, default=window)

    def find(self, w: Words):
        """(row, first word, end word, items) of each hit; words count from the row's first.

        Names tell which stretches to stream; there each word is compared with
        the item word of its name, and one that differs is none of the items'.
        """
        names, at = w.names(), w.at
        if not len(names) or not self.total:
            return
        where = np.minimum(np.searchsorted(self.names, names), self.total - 1)
        word = np.where(self.names[where] == names, self.number[where], -1)
        joined = np.zeros(len(word), bool)
        pair = word[:-1] * self.total + word[1:]
        if len(self.pairs):
            spot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:] = (self.pairs[spot] == pair) & (word[:-1] >= 0) & (word[1:] >= 0)
        joined[at[:-1][at[:-1] < len(word)]] = False
        known = word >= 0
        begin = np.flatnonzero(known & ~joined)
        stop = np.append(joined[1:], False)
        end = np.flatnonzero(known & ~stop) + 1
        use = end - begin >= self.least
        begin, end = begin[use], end[use]
        row = np.searchsorted(at, begin, side="right") - 1
        for r, b, e in zip(row.tolist(), begin.tolist(), end.tolist()):
            base = b - int(at[r])
            run = word[b:e].tolist()
            body = w.data[w.start[b] : w.end[e - 1]].tobytes().translate(_TO_SPACE).split()
            run = [c if self.words[c] == x else -1 for c, x in zip(run, body)]
            for i, n, items in self.automaton.stream(run):
                yield r, base + i + 1 - n, base + i + 1, items


def _scan(block: Block, w: Words) -> tuple[np.ndarray, list[set[str]]]:
    """(hit by word, items by row)."""
    found = [set() for _ in w.count]
    step = np.zeros(int(w.at[-1]) + 1, np.int64)
    for r, i, j, items in block.find(w):
        found[r].update(block.ids[x] for x in items)
        step[w.at[r] + i] += 1
        step[w.at[r] + j] -= 1
    return np.cumsum(step)[:-1] > 0, found


def _spans(hit: np.ndarray, w: Words) -> list[bytes]:
    """By row, the stretches of hit words as pairs (first, end)."""
    out = []
    for a, z in zip(w.at[:-1].tolist(), w.at[1:].tolist()):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:z], [False]]).astype(np.int8))) if hit[a:z].any() else np.zeros(0, np.int64)
        out.append(edge.astype(np.int64).tobytes())
    return out


FOUND = "doc_id long, key binary, n_words long, items array<string>, spans binary"


def _found(block, window: int):
    def run(batches):
        built = None
        for b in pieces(batches):
            built = built or Block(*block.value, window)
            w = Words(b.column("text"), NOT_ALNUM, lower=True)
            hit, found = _scan(built, w)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(w.digests(), pa.binary()), pa.array(w.count, pa.int64()), pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array(_spans(hit, w), pa.binary())],
                names=["doc_id", "key", "n_words", "items", "spans"],
            )

    return run


def _united(batches):
    """Rows with the items and spans of several blocks made one."""
    for b in batches:
        items, spans, hits = [], [], []
        for many, parts in zip(b.column("items").to_pylist(), b.column("spans").to_pylist()):
            items.append(sorted({x for m in many or () for x in m}))
            out = []
            for i, j in sorted(tuple(x) for p in parts or () for x in np.frombuffer(p, np.int64).reshape(-1, 2).tolist()):
                if out and i <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], j)
                else:
                    out.append([i, j])
            spans.append(np.array(out, np.int64).tobytes())
            hits.append(sum(j - i for i, j in out))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("key"), b.column("n_words"), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.binary()), pa.array(hits, pa.int64())],
            names=["doc_id", "key", "n_words", "items", "spans", "n_hit"],
        )


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list[tuple[list[str], list[str]]]:
    """The items as (ids, texts) by block; each block is fetched by itself and is no larger than block_words or one item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = -(-total // (6 * block_words)) or 1
    for k in range(n):
        rows = items.filter(F.expr(f"pmod(xxhash64(id, text), {n}) = {k}")).collect() if n > 1 else items.collect()
        yield [r["id"] for r in rows], [r["text"] for r in rows]


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, key, n_words, n_hit, items, spans of every row of docs.

    Words are lower-case letters, digits and everything from 0x80 on.  A window
    is `window` consecutive words of an item; an item of fewer words is one
    window, one of none has none.  A word inside any occurrence of a window is
    hit; items holds the ids, as strings, of the items with occurring windows,
    and spans the stretches of hit words as pairs of 64-bit (first, end).  key
    names the row's words.  A null text has no words, a null item no windows, an
    item without an id has an empty one; rows that repeat count once in items.
    Columns beyond doc_id, text and item_id, text aren't read.
    """
    spark = docs.sparkSession
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [docs.mapInArrow(_found(spark.sparkContext.broadcast(b), window), FOUND) for b in item_blocks(benchmark, block_words)]
    shape = FOUND + ", n_hit long"
    if len(parts) == 1:
        one = parts[0].select("doc_id", "key", "n_words", F.array("items").alias("items"), F.array("spans").alias("spans"))
        return one.mapInArrow(_united, shape)
    hits = parts[0].filter("size(items) > 0")
    for p in parts[1:]:
        hits = hits.union(p.filter("size(items) > 0"))
    hits = hits.groupBy("doc_id", "key").agg(F.collect_set("items").alias("items"), F.collect_set("spans").alias("spans"))
    base = parts[0].select("doc_id", "key", "n_words")
    on = base["doc_id"].eqNullSafe(hits["doc_id"]) & (base["key"] == hits["key"])
    return base.join(hits, on, "left").select(base["doc_id"], base["key"], "n_words", "items", "spans").mapInArrow(_united, shape)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = 2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; see benchmark_matches()."""
    m = benchmark_matches(docs, benchmark, window, block_words)
    return m.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") >= least_items).alias("contaminated")
    )


def cleaned_text(text: str | None, spans: list[list[int]], longest: int) -> str | None:
    """text without the stretches of over `longest` hit words; what stood between the words goes with them."""
    cut = [(i, j) for i, j in spans if j - i > longest]
    if not cut:
        return text
    w = Words(pa.array([text]), NOT_ALNUM, lower=True)
    raw, out, at = text.encode(), [], 0
    for i, j in cut:
        out.append(raw[at : int(w.start[i])])
        at = int(w.end[j - 1])
    return b"".join([*out, raw[at:]]).decode()


def _cleaned(longest: int, coverage: float, schema: T.StructType, text: str, found: list[str]):
    def run(batches):
        for b in pieces(batches, text):
            rows, texts = [], []
            for i, (t, n, hits, spans) in enumerate(zip(b.column(text).to_pylist(), *(b.column(k).to_pylist() for k in found))):
                if hits and hits > coverage * n:
                    continue
                rows.append(i)
                texts.append(cleaned_text(t, np.frombuffer(spans, np.int64).reshape(-1, 2).tolist(), longest) if hits else t)
            b = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == text else b.column(k) for k in schema.names], names=schema.names)

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, longest: int = 0, coverage: float = 0.5) -> DataFrame:
    """docs without the benchmark's passages; the columns of docs.

    A row goes if over `coverage` of its words are hit; in the others, stretches
    of more than `longest` hit words are cut out.  Rows are matched to their hits
    by doc_id and words, so rows that repeat a doc_id are told apart.  A null
    text stays; an empty table gives no rows; further columns are kept as they
    are, whatever their names.
    """
    own = {k: unused(docs, k) for k in ("id", "key", "n", "hit", "spans", "doc_key")}
    found = {"id": "doc_id", "key": "key", "n": "n_words", "hit": "n_hit", "spans": "spans"}
    m = benchmark_matches(docs, benchmark, window).filter("n_hit > 0").select(*(F.col(c).alias(own[k]) for k, c in found.items()))
    m = written(m.dropDuplicates([own["id"], own["key"]]), "hits")
    keyed = docs.mapInArrow(_with_key(docs.schema, own["doc_key"]), T.StructType([*docs.schema.fields, T.StructField(own["doc_key"], T.BinaryType())]))
    on = keyed["doc_id"].cast("long").eqNullSafe(m[own["id"]]) & (keyed[own["doc_key"]] == m[own["key"]])
    rows = keyed.join(sized(m, 300), on, "left").drop(own["id"], own["key"], own["doc_key"])
    return rows.mapInArrow(_cleaned(longest, coverage, docs.schema, "text", [own[k] for k in ("n", "hit", "spans")]), docs.schema)


def _with_key(schema: T.StructType, key: str):
    def run(batches):
        for b in pieces(batches):
            keys = Words(b.column("text"), NOT_ALNUM, lower=True).digests()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=[*schema.names, key])

    return run

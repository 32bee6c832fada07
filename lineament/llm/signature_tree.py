"""N-gram Jaccard join by signature trees.

A text's set holds the 64-bit names of its word n-grams.  Texts with the same
words form one class, of which one stands for all.  What could link is found in
steps of which none leaves out a linked pair:

* Names.  A set of a size class is cut into K ranges of hash values, K being
  more than the largest symmetric difference that still links plus an allowance
  for empty ranges, so two linked sets agree on a whole non-empty range.  Small
  sets, and those with more empty ranges than allowed, meet on a member of
  their prefix of least names instead.  Range names travel as packed arrays.
* Leaders.  The least class of a name leads it.  Each class meets each of its
  leaders once, however many names they share.
* Trees.  All that meet one leader are its cell, so classes that share a name
  share a cell.  Leaves hold token bitmaps of sets of similar size; a node holds
  the OR of its children's bitmaps, their size range, and the largest number of
  tokens of one set that fell on a bit already taken.  Two trees, or one with
  itself, are walked together; a pair of nodes is left when its largest possible
  overlap is too small for its sizes, or when all below it are linked already,
  or would be by pairs that the walk has given before.  Those pairs are compared;
  where one of them turns out not to link, its cell is walked again without it.

Only bitmaps and sizes are sent to cells.  Texts are sent for the pairs that the
trees leave, and those pairs are compared word by word.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineament.llm.packed import SHAPE, Entries, dealt, decided, parts_of, shared
from lineament.llm.words import Words, bounded, gram_names, mix, pieces, trim, unused
from lineament.operators.graph import components
from lineament.plans.storage import dropped, partitions, sized, written

SMALL, RATIO, CELL, LEAF, FAN = 32, 1.5, 8192, 32, 8
#: Tokens up to which a set's bitmap has eight bits for each; larger ones have one and a half at least.
FINE = 512
#: How many times more pairs each walk of a cell gives for two groups before it takes them for linked; the first gives one.
MORE = 8
_u = np.uint64


def overlap_needed(nx, ny, percent: int):
    """Least intersection with 100 * i >= percent * (nx + ny - i)."""
    return -(-percent * (nx + ny) // (100 + percent))


def size_classes(percent: int, top: int) -> list[tuple[int, int, int]]:
    """(largest size, ranges K, allowance e) of the classes over SMALL, up to one that holds top."""
    out, low = [], SMALL
    while not out or out[-1][0] < top:
        high = int(low * RATIO)
        k, e = 2 * (100 - percent) * high // (100 + percent), 1
        for _ in range(8):
            empty = (k + 1 + e) * math.exp(-(low + 1) / (k + 1 + e))
            e = max(1, math.ceil(empty + 2.3 * math.sqrt(empty)))
        out.append((high, k + 1 + e, e))
        low = high
    return out


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, at): each row's distinct n-grams in order of name; fewer words are one gram, none give none."""
    names, at, count = words.names(), words.at, words.count
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(grams)])
    start = np.arange(out_at[-1]) - np.repeat(out_at[:-1], grams) + np.repeat(at[:-1], grams)
    value, whole = np.zeros(len(start), np.uint64), np.repeat(count >= n, grams)
    value[whole] = gram_names(names, n)[start[whole]]
    for c in set(count[(count > 0) & (count < n)].tolist()):
        rows = np.flatnonzero(count == c)
        value[out_at[rows]] = gram_names(names, c)[at[rows]]
    for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist()):
        value[a:b].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = value[1:] != value[:-1]
    fresh[out_at[:-1][grams > 0]] = True
    return value[fresh], np.concatenate([[0], np.cumsum(fresh)])[out_at]


def meeting_names(value: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, rows): under what names each row's set can meet those that it may link with."""
    size = np.diff(at)
    names, rows = [], []
    prefix = (size > 0) & (size * percent <= SMALL * 100)
    classes = size_classes(percent, int(size.max(initial=1) * 100 // percent + 1))
    highs = np.array([c[0] for c in classes])
    own = np.searchsorted(highs, size)
    last = np.searchsorted(highs, size * 100 // percent)
    for c, (_, k, e) in enumerate(classes):
        of = np.flatnonzero((size > SMALL) & (own <= c) & (c <= last))
        if not len(of):
            continue
        n = size[of]
        row = np.repeat(of, n)
        h = value[np.repeat(at[of] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        part = ((h >> _u(32)) * _u(k)) >> _u(32)
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
        total = np.add.reduceat(mix(h), first)
        names.append(mix(total + mix(part[first] + _u(c + 1) * _u(1 << 32))))
        rows.append(row[first])
        filled = np.bincount(row[first], minlength=len(size))
        prefix[of[k - filled[of] > e]] = True
    of = np.flatnonzero(prefix)
    n = size[of] - -(-size[of] * percent // 100) + 1
    names.append(value[np.repeat(at[of] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(of) else value[:0])
    rows.append(np.repeat(of, n))
    return np.concatenate(names), np.concatenate(rows)


def node(key: bytes) -> int:
    """What stands for a digest where 64 bits do."""
    return int.from_bytes(key[:8], "little", signed=True)


def signature(tokens: np.ndarray) -> bytes:
    """A set's bitmap, of 64 bits at least and a power of two."""
    n = len(tokens)
    bits = max(64, 1 << math.ceil(math.log2(8 * n if n <= FINE else max(8 * FINE, 1.5 * n))))
    out = np.zeros(bits, bool)
    out[((tokens >> _u(20)) & _u(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A bitmap, or rows of them, as if it had been made with that many 64-bit words."""
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] | bitmap[..., half:]
    return bitmap


def possible(nx: int, x: bytes, ny: int, y: bytes, percent: int) -> bool:
    """Whether two sets' sizes and bitmaps leave room for a link: a bit that one has alone is a token that it has alone."""
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    words = min(len(a), len(b))
    a, b = folded(a, words), folded(b, words)
    most = min(nx - int(np.bitwise_count(a & ~b).sum()), ny - int(np.bitwise_count(b & ~a).sum()))
    return most >= overlap_needed(nx, ny, percent)


SET = "doc_id long, n_shingles long, digest binary, node long, bitmap binary"


def _sets(n: int):
    def run(batches):
        for b in pieces(batches):
            words = Words(b.column("text"), lower=True)
            value, at = shingle_sets(words, n)
            keys = words.digests()
            maps = [signature(value[i:j]) if j > i else None for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(keys, pa.binary()), pa.array([node(k) for k in keys], pa.int64()), pa.array(maps, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "node", "bitmap"],
            )

    return run


def _meetings(n: int, percent: int, parts: int):
    def entries(batches):
        for b in pieces(batches):
            words = Words(b.column("text"), lower=True)
            value, at = shingle_sets(words, n)
            key = np.array([node(k) for k in words.digests()], np.int64)
            name, row = meeting_names(value, at, percent)
            yield Entries(name, key[row])

    return lambda batches: dealt(entries(batches), shared, parts)


def _met(e: Entries) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(e.name.view(np.int64)), pa.array(e.owner)], names=["name", "node"])


def _possible(percent: int):
    def run(batches):
        for b in batches:
            keep = [possible(*x, percent) for x in zip(*(b.column(k).to_pylist() for k in ("n_a", "bitmap_a", "n_b", "bitmap_b")))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class Tree:
    """Signature tree over members (node, label, size, bitmap) given in the order of its leaves; levels from leaves up.

    A level has, by node: the OR of bitmaps, least and largest size, the most
    tokens that one set has beyond its bits, least and largest label, first and
    end member.
    """

    def __init__(self, members: list[tuple], words: int):
        self.node = [m[0] for m in members]
        self.label, self.size = (np.array([m[k] for m in members], np.int64) for k in (1, 2))
        self.maps = np.stack([folded(np.frombuffer(m[3], "<u8"), words) for m in members])
        slack = self.size - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        self.levels = []
        step, rows = LEAF, (self.maps, self.size, self.size, slack, self.label, self.label)
        while True:
            at = np.arange(0, len(rows[1]), FAN if self.levels else LEAF)
            ways = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            rows = tuple(way.reduceat(x, at) for way, x in zip(ways, rows))
            start = np.arange(len(at)) * step
            self.levels.append((*rows, start, np.minimum(start + step, len(members))))
            step *= FAN
            if len(at) == 1:
                break

    def children(self, level: int, i: int) -> list[tuple[int, int]]:
        return [(level - 1, j) for j in range(i * FAN, min((i + 1) * FAN, len(self.levels[level - 1][1])))]


def grouped(members: list[tuple]) -> dict[int, list[tuple]]:
    """Members by their bitmap's words, in the order of leaves: of similar size, then by label."""
    out: dict[int, list[tuple]] = {}
    for m in sorted(members, key=lambda m: (len(m[3]), int(math.log(m[2]) * 10), m[1], m[0])):
        out.setdefault(len(m[3]) // 8, []).append(m)
    return out


class Groups:
    """Labels that count as one in a walk: union-find over their places in order."""

    def __init__(self, labels: np.ndarray):
        self.names = np.unique(labels)
        self.up = np.arange(len(self.names))

    def roots(self, labels) -> np.ndarray:
        at = np.searchsorted(self.names, labels)
        while True:
            up = self.up[at]
            if np.array_equal(up, at):
                return at
            at = up

    def root(self, label: int) -> int:
        at = int(np.searchsorted(self.names, label))
        while self.up[at] != at:
            self.up[at] = at = int(self.up[self.up[at]])
        return at

    def join(self, a: int, b: int) -> None:
        self.up[max(a, b)] = min(a, b)


def tree_pairs(left: list[tuple], right: list[tuple] | None, percent: int, limit: int = 1, refuted: frozenset | set = frozenset()) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of members of different labels that may link, inside left or between left and right, and whether any were passed over.

    Groups of which `limit` pairs were given count as linked from then on, and
    pairs within what counts as linked are passed over.  Pairs in refuted, in
    either order, are neither given nor counted.
    """
    out: list[tuple[int, int]] = []
    given: dict[tuple[int, int], int] = {}
    skipped = False
    groups = Groups(np.array([m[1] for m in [*left, *(right or ())]], np.int64))

    def walk(a: Tree, b: Tree) -> None:
        nonlocal skipped
        stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
        while stack:
            la, na, lb, nb = stack.pop()
            ma, loa, hia, sla, fa, ta, sa, ea = (x[na] for x in a.levels[la])
            mb, lob, hib, slb, fb, tb, sb, eb = (x[nb] for x in b.levels[lb])
            if fa == ta == fb == tb or hia * 100 < percent * lob or hib * 100 < percent * loa:
                continue
            most = min(int(np.bitwise_count(ma & mb).sum()) + min(int(sla), int(slb)), int(hia), int(hib))
            if most < overlap_needed(int(loa), int(lob), percent):
                continue
            if fa == ta and fb == tb and groups.root(int(fa)) == groups.root(int(fb)):
                skipped = True
                continue
            if la or lb:
                down_a = a.children(la, na) if la and la >= lb else [(la, na)]
                down_b = b.children(lb, nb) if lb and lb >= la else [(lb, nb)]
                stack += [(*x, *y) for x in down_a for y in down_b if a is not b or x <= y]
                continue
            rows = max(1, (1 << 18) // ((eb - sb) * a.maps.shape[1]))
            for r in range(sa, ea, rows):
                x, y = a.maps[r : min(r + rows, ea), None], b.maps[None, sb:eb]
                e = r + x.shape[0]
                size_a, size_b = a.size[r:e, None], b.size[None, sb:eb]
                over = np.minimum(size_a - np.bitwise_count(x & ~y).sum(2, dtype=np.int64), size_b - np.bitwise_count(y & ~x).sum(2, dtype=np.int64))
                able = (over >= overlap_needed(size_a, size_b, percent)) & (a.label[r:e, None] != b.label[None, sb:eb])
                if a is b and na == nb:
                    able &= np.arange(r, e)[:, None] < np.arange(sb, eb)[None]
                for i, j in np.argwhere(able).tolist():
                    p, q = r + i, sb + j
                    ra, rb = groups.root(int(a.label[p])), groups.root(int(b.label[q]))
                    if ra == rb:
                        skipped = True
                        continue
                    m, n = a.node[p], b.node[q]
                    if (m, n) in refuted or (n, m) in refuted:
                        continue
                    key = (min(ra, rb), max(ra, rb))
                    given[key] = given.get(key, 0) + 1
                    out.append((m, n))
                    if given[key] >= limit:
                        groups.join(*key)

    groups_a = grouped(left)
    groups_b = groups_a if right is None else grouped(right)
    for wa, xs in groups_a.items():
        for wb, ys in groups_b.items():
            if right is None and wb < wa:
                continue
            words = min(wa, wb)
            a = Tree(xs, words)
            walk(a, a if xs is ys else Tree(ys, words))
    return out, skipped


WALKED = "c long, a long, b long"


def _walked(percent: int, limit: int):
    """Pairs (c, a, b) of cells (c, i, j) whose rows come one cell after another; (c, null, null) says that some were passed over.

    Side 0 and 1 hold members; side 2 pairs that were refuted, as node and label.
    """

    def found(cell, left, right, refuted):
        pairs, skipped = tree_pairs(left, right or None, percent, limit, refuted) if len(left) + len(right) > 1 else ([], False)
        return [*((cell[0], a, b) for a, b in pairs), *([(cell[0], None, None)] if skipped else [])]

    def run(batches):
        cell, left, right, refuted = None, [], [], set()
        for batch in chain(batches, [None]):
            out = []
            for *c, side, node_, label, n, bitmap in zip(*(batch.column(k).to_pylist() for k in ("c", "i", "j", "side", "node", "label", "n", "bitmap"))) if batch else [(None,) * 8]:
                if c != cell:
                    out += found(cell, left, right, refuted) if left else []
                    cell, left, right, refuted = c, [], [], set()
                if side == 2:
                    refuted.add((node_, label))
                else:
                    (right if side else left).append((node_, label, n, bitmap))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([r[k] for r in out] for k in range(3))], names=["c", "a", "b"])
        trim()

    return run


def _texts(batches):
    """Rows (node, digest, text) whose text has the words that the digest stands for."""
    for b in pieces(batches):
        own = [d == k for d, k in zip(b.column("digest").to_pylist(), Words(b.column("text"), lower=True).digests())]
        yield b.select(["node", "text"]).filter(pa.array(own, pa.bool_()))


def words_link(x: bytes, y: bytes, n: int, percent: int) -> bool:
    """Whether two lower-cased texts link, by their words themselves."""
    a, b = x.split(), y.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in chain(a, b)), np.int64, len(a) + len(b))
    if min(len(a), len(b)) < n:
        return a == b
    ends, grams = (len(a), len(a) + len(b)), ids
    for k in range(1, n):  # each step numbers the grams of one word more; those across the texts' border are left out below
        grams = np.unique(grams[:-1] * len(number) + ids[k:], return_inverse=True)[1]
    p, q = np.unique(grams[: ends[0] - n + 1]), np.unique(grams[ends[0] :])
    return len(np.intersect1d(p, q, assume_unique=True)) >= overlap_needed(len(p), len(q), percent)


def _linked(n: int, percent: int):
    def run(batches):
        for b in pieces(batches, "x"):
            x, y = Words(b.column("x"), lower=True), Words(b.column("y"), lower=True)
            (p, at), (q, bt) = shingle_sets(x, n), shingle_sets(y, n)
            keep = []
            for i in range(b.num_rows):
                s, t = p[at[i] : at[i + 1]], q[bt[i] : bt[i + 1]]
                both = np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s) if len(t) else 0
                near = both >= overlap_needed(len(s), len(t), percent)
                keep.append(near and words_link(x.data[x.off[i] : x.off[i + 1]].tobytes(), y.data[y.off[i] : y.off[i + 1]].tobytes(), n, percent))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compared(docs: DataFrame, pairs: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b), a stored table, whose texts link; each text is sent once for all its pairs as a, and by pair as b."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(ends.join(members.select("node", "doc_id", "digest"), "node"), "wanted")
    texts = docs.join(sized(wanted, 64), "doc_id").select("node", "digest", "text").mapInArrow(_texts, "node long, text string")
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
    x, y = texts.select(F.col("node").alias("a"), F.col("text").alias("x")), texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    links = written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_linked(shingle, percent), "a long, b long"), "links")
    dropped(wanted)
    dropped(texts)
    return links


def _cells(stars: DataFrame, members: DataFrame, labels: DataFrame, cell_rows: int, only: DataFrame | None, refuted: DataFrame | None) -> DataFrame:
    """Rows (c, i, j, side, node, label, n, bitmap) of the leaders' cells, or some only (c), that hold two labels.

    A cell of more than cell_rows is dealt into blocks by hash, and each two of
    them meet as sides of a cell of their own.  Pairs (c, a, b) that were refuted
    go where their members meet.
    """
    rows = stars.select(F.col("a").alias("c"), F.col("b").alias("node"))
    if only is not None:
        rows = rows.join(sized(only, 16), "c", "left_semi")
    rows = rows.join(sized(labels, 32), "node", "left").select("c", "node", F.coalesce("component", "node").alias("label"))
    count = rows.groupBy("c").agg(F.count("*").alias("size"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most")
    count = sized(written(count.select("c", F.ceil(F.col("size") / cell_rows).cast("int").alias("blocks")), "open"), 32)
    block = lambda k: F.expr(f"cast(pmod(xxhash64({k}), blocks) as int)")
    rows = rows.join(count, "c").join(sized(members.select("node", F.col("n_shingles").alias("n"), "bitmap"), 600), "node")
    rows = rows.withColumn("block", block("node")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("c", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "label", "n", "bitmap")
    if refuted is not None:
        not_linked = refuted.join(count, "c").withColumn("x", block("a")).withColumn("y", block("b"))
        ends = [F.col("a").alias("node"), F.col("b").alias("label"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("bitmap")]
        rows = rows.union(not_linked.select("c", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.lit(2).alias("side"), *ends))
    return rows


def linked_classes(docs: DataFrame, shingle: int, percent: int, cell_rows: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(sets, groups) of docs (doc_id, text).

    sets has a row for each of docs: doc_id, n_shingles, digest, node, bitmap.
    groups has, for each digest whose class isn't one row alone, the least
    doc_id (component) and its digest (leader) among all texts linked with it.
    """
    spark = docs.sparkSession
    sets = written(docs.mapInArrow(_sets(shingle), SET), "sets")
    some = sets.filter("n_shingles > 0 and doc_id is not null")
    firsts = written(some.groupBy("digest", "node").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "firsts")
    met = docs.filter("doc_id is not null").mapInArrow(_meetings(shingle, percent, parts_of(spark)), SHAPE)
    met = written(decided(met, shared, _met, "name long, node long"), "met")
    leads = met.groupBy("name").agg(F.min("node").alias("a"))
    stars = written(met.join(leads, "name").filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "stars")
    dropped(met)
    ends = stars.select(F.col("a").alias("node")).union(stars.select(F.col("b").alias("node"))).distinct()
    chosen = written(ends.join(firsts.select("node", "digest", F.col("first").alias("doc_id")), "node"), "chosen")
    own = sets.select("doc_id", "digest", "n_shingles", "bitmap").join(sized(chosen, 64), ["doc_id", "digest"])
    members = written(own.dropDuplicates(["doc_id", "digest"]).select("node", "doc_id", "digest", "n_shingles", "bitmap"), "members")
    dropped(chosen)

    # each class with its leaders
    sizes = members.select("node", "n_shingles")
    pairs = stars.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    maps = members.select("node", "bitmap")
    pairs = pairs.join(maps.toDF("a", "bitmap_a"), "a").join(maps.toDF("b", "bitmap_b"), "b")
    pairs = written(pairs.select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(_possible(percent), "a long, b long"), "pairs")
    links = [_compared(docs, pairs, members, shingle, percent)]
    dropped(pairs)

    # what met the same leader, by trees; again in cells of which a pair was refuted and others were passed over
    limit, only, refuted, labels = 1, None, None, written(components(links[0]), "labels")
    while True:
        cells = _cells(stars, members, labels, cell_rows, only, refuted)
        cells = cells.repartition(partitions(spark), "c", "i", "j").sortWithinPartitions("c", "i", "j")
        walked = written(cells.mapInArrow(_walked(percent, limit), WALKED), "walked")
        pairs = written(walked.filter("a is not null").select("a", "b").distinct(), "pairs")
        new = _compared(docs, pairs, members, shingle, percent)
        wrong = walked.filter("a is not null").join(sized(new, 16), ["a", "b"], "left_anti").select("c", "a", "b")
        wrong = written(wrong if refuted is None else wrong.union(refuted), "refuted")
        again = written(wrong.select("c").distinct().join(walked.filter("a is null").select("c").distinct(), "c", "left_semi"), "again")
        for one in (pairs, walked, only, refuted):
            if one is not None:
                dropped(one)
        if new.limit(1).count():
            links.append(new)
            every = links[0]
            for one in links[1:]:
                every = every.union(one)
            dropped(labels)
            labels = written(components(every), "labels")
        limit, only, refuted = limit * MORE, again, wrong
        if not again.limit(1).count():
            break
    dropped(only)
    dropped(refuted)
    for one in links:
        dropped(one)
    dropped(stars)
    dropped(members)
    tops = firsts.join(labels, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = tops.groupBy("group").agg(F.min(F.struct(F.col("first").alias("component"), F.col("digest").alias("leader"))).alias("top"), F.sum("rows").alias("rows_"))
    groups = tops.select("digest", "group").join(least.filter("rows_ > 1"), "group").select("digest", "top.component", "top.leader")
    groups = written(groups, "groups")
    dropped(firsts)
    dropped(labels)
    return sets, groups


def _read(docs: DataFrame) -> DataFrame:
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def jaccard_groups(docs: DataFrame, shingle: int = 3, percent: int = 90, cell_rows: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text, ...).

    Two texts link when 100 * |intersection| >= percent * |union| of their sets
    of distinct word n-grams; component_id is the least doc_id reachable.  Equal
    sets link.  A null or wordless text has no n-gram and is alone.  A row with a
    null doc_id takes part in no link and has a null component_id.  Rows that
    repeat a doc_id each get a row, by their own text.  Columns beyond doc_id and
    text aren't read.  An empty table gives no rows.
    """
    sets, groups = linked_classes(_read(docs), shingle, percent, cell_rows)
    out = sets.join(sized(groups.select("digest", "component"), 48), "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def single_documents(docs: DataFrame, shingle: int = 5, percent: int = 80, cell_rows: int = CELL) -> DataFrame:
    """docs without those linked with a document of a smaller doc_id; the columns of docs.

    Of a group linked as in jaccard_groups() the document of the least doc_id
    stays; if two texts have that doc_id, the one of the smaller digest of words.
    Rows that repeat both doc_id and words are one document and stay or go
    together, whatever their other columns hold.  Rows without a doc_id or without words stay.
    """
    sets, groups = linked_classes(_read(docs), shingle, percent, cell_rows)
    lost = sets.filter("doc_id is not null and n_shingles > 0").select("doc_id", "digest").join(sized(groups, 64), "digest")
    lost = written(lost.filter("doc_id <> component or digest <> leader").select(F.col("doc_id").alias("__lost"), F.col("digest").alias("__of")).distinct(), "lost")
    dropped(sets)
    dropped(groups)
    key = unused(docs, "words")
    keyed = docs.mapInArrow(_with_digest(docs.columns, key), T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())]))
    on = (keyed["doc_id"].cast("long") == lost["__lost"]) & (keyed[key] == lost["__of"])
    return keyed.join(sized(lost, 48), on, "left_anti").select(*(keyed[c] for c in docs.columns))


def _with_digest(names: list[str], key: str):
    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(Words(b.column("text"), lower=True).digests(), pa.binary())], names=[*names, key])

    return run

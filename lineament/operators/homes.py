"""Kernels over lines and the cells about them, without a row for each pair of line and cell.

A line lives in one tile, that of its lower corner, of a side no less than its
own extent: two tiles each way hold all its cells.  A tile's lines are dealt
to as many groups as their number asks for, and the cells go once to each group
that sees them, so what travels grows with lines and tiles, not with pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineament.plans.storage import partitions, sized, written

#: Log2 of the least and the largest tile's side, and lines in a group.
LEAST, MOST, LINES = 5, 10, 8192
BOUNDS = ("lx0", "ly0", "lx1", "ly1")


def split(lines: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """lines (with bounds), stored: those that a tile holds, and those that are larger, if there are any."""
    lines = written(lines, "lines")
    size = F.greatest(F.col("lx1") - F.col("lx0"), F.col("ly1") - F.col("ly0"))
    ok = F.coalesce(size < (1 << MOST) - 1, F.lit(False))
    far = lines.filter(~ok)
    return lines.filter(ok), far if far.limit(1).count() else None


def by_homes(lines: DataFrame, cells: DataFrame, kernel: Callable, shape: str, schema: pa.Schema, lines_a_group: int = LINES, flags: tuple[str, ...] = ()) -> DataFrame:
    """kernel(table, window) over groups of lines that lie together, as rows of shape.

    lines have a line_id, maybe a part, their bounds and what the kernel wants;
    cells (r, c, v) and the flags named.  A cell belongs to the lines within
    whose bounds its middle lies.  The kernel gets a group's lines as an Arrow
    table and their Window, and gives a dictionary of Arrow arrays.
    """
    spark = lines.sparkSession
    size = F.greatest(F.col("lx1") - F.col("lx0"), F.col("ly1") - F.col("ly0")) + 1
    own = lines.withColumn("k", F.greatest(F.ceil(F.log2(size)), F.lit(LEAST)).cast("int"))
    side = F.expr("shiftleft(1L, k)")
    own = own.withColumn("hx", F.floor(F.col("lx0") / side).cast("long")).withColumn("hy", F.floor(F.col("ly0") / side).cast("long"))
    tiles = written(own.groupBy("k", "hx", "hy").agg(F.ceil(F.count("*") / lines_a_group).cast("int").alias("salts")), "tiles")
    levels = [r.k for r in tiles.select("k").distinct().collect()]
    keys = ["k", "hx", "hy", "salt"]
    few = sized(tiles, 40)
    own = own.join(few, ["k", "hx", "hy"]).withColumn("salt", F.pmod(F.xxhash64(*(c for c in ("line_id", "part") if c in lines.columns)), F.col("salts")).cast("int")).drop("salts")
    seen = cells.select("r", "c", F.col("v").cast("double").alias("v"), *flags, F.explode(F.array(*(F.lit(k) for k in levels)) if levels else F.array().cast("array<int>")).alias("k"))
    for at, name in (("c", "hx"), ("r", "hy")):  # a cell is seen from its tile and the one before
        t = F.floor(F.col(at) / side).cast("long")
        seen = seen.withColumn(name, F.explode(F.array(t, t - 1)))
    seen = seen.join(few, ["k", "hx", "hy"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    n = partitions(spark)
    none = schema.empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        out = kernel(left, Window.of(right, flags))
        return pa.table(out, schema=schema) if out else none

    # dealt by number, as tasks of few bytes and much work must not be put together
    a, b = own.repartition(n, *keys), seen.repartition(n, *keys)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, shape)


def by_boxes(left: DataFrame, right: DataFrame, kernel: Callable, shape: str, schema: pa.Schema, left_a_group: int, rb=("rx0", "ry0", "rx1", "ry1")) -> DataFrame:
    """kernel(left table, right table) over groups of left rows that lie together and all right rows that may meet them, as rows of shape.

    left has BOUNDS, right those of rb.  A left row is in one group alone, so a
    pair is met once; no row is made for a pair.  A group without right rows is
    left out, and rows with a null bound or bounds the wrong way meet nothing.
    """
    spark = left.sparkSession
    size = F.greatest(F.col("lx1") - F.col("lx0"), F.col("ly1") - F.col("ly0")) + 1
    own = left.filter("lx0 <= lx1 and ly0 <= ly1").withColumn("k", F.greatest(F.ceil(F.log2(size)), F.lit(LEAST)).cast("int"))
    side = F.expr("shiftleft(1L, k)")
    own = written(own.withColumn("hx", F.floor(F.col("lx0") / side).cast("long")).withColumn("hy", F.floor(F.col("ly0") / side).cast("long")), "homes")
    tiles = written(own.groupBy("k", "hx", "hy").agg(F.ceil(F.count("*") / left_a_group).cast("int").alias("salts")), "tiles")
    levels = [r.k for r in tiles.select("k").distinct().collect()]
    keys = ["k", "hx", "hy", "salt"]
    few = sized(tiles, 40)
    own = own.join(few, ["k", "hx", "hy"]).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts")).cast("int")).drop("salts")
    seen = right.filter(f"{rb[0]} <= {rb[2]} and {rb[1]} <= {rb[3]}").withColumn("k", F.explode(F.array(*(F.lit(k) for k in levels)) if levels else F.array().cast("array<int>")))
    for low, high, name in ((rb[0], rb[2], "hx"), (rb[1], rb[3], "hy")):  # seen from the tiles it touches and the one before
        seen = seen.withColumn(name, F.explode(F.sequence(F.floor(F.col(low) / side).cast("long") - 1, F.floor(F.col(high) / side).cast("long"))))
    seen = seen.join(few, ["k", "hx", "hy"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    n = partitions(spark)
    none = schema.empty_table()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table(kernel(a, b), schema=schema) if a.num_rows and b.num_rows else none

    a, b = own.repartition(n, *keys), seen.repartition(n, *keys)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, shape)


def meeting(left: pa.Table, right: pa.Table, rb=("rx0", "ry0", "rx1", "ry1"), most: int = 1 << 22):
    """(i, j) of the rows of two tables whose bounds meet, edges included, by i: in pieces of some left rows each."""
    l = [left.column(k).to_numpy()[:, None] for k in BOUNDS]
    r = [right.column(k).to_numpy() for k in rb]
    step = max(1, most // max(1, right.num_rows))
    for k in range(0, left.num_rows, step):
        own = slice(k, k + step)
        i, j = np.nonzero((l[0][own] <= r[2]) & (r[0] <= l[2][own]) & (l[1][own] <= r[3]) & (r[1] <= l[3][own]))
        yield i + k, j


class Window:
    """A grid of cells: there, v (nan where there is none) and flags by name from (r0, c0) on."""

    def __init__(self, r: np.ndarray, c: np.ndarray, v: np.ndarray, flags: dict[str, np.ndarray] | None = None):
        self.r0, self.c0 = int(r.min()), int(c.min())
        size = (int(r.max()) - self.r0 + 1, int(c.max()) - self.c0 + 1)
        self.there, self.v = np.zeros(size, bool), np.full(size, np.nan)
        self.there[r - self.r0, c - self.c0] = True
        self.v[r - self.r0, c - self.c0] = v.astype(float)
        self.flags = {}
        for name, flag in (flags or {}).items():
            self.flags[name] = np.zeros(size, bool)
            self.flags[name][r - self.r0, c - self.c0] = flag

    @classmethod
    def of(cls, table: pa.Table, flags: tuple[str, ...] = ()) -> Window:
        """The window of a table's cells (r, c, v) and flags."""
        return cls(*(table.column(k).to_numpy(zero_copy_only=False) for k in ("r", "c", "v")), {k: table.column(k).to_numpy(zero_copy_only=False) for k in flags})

    def spans(self, lx0: np.ndarray, ly0: np.ndarray, lx1: np.ndarray, ly1: np.ndarray) -> tuple[np.ndarray, ...]:
        """(i0, i1, j0, j1): rows and columns of the grid whose middles lie within bounds, ends not included."""
        rows, cols = self.there.shape
        low = lambda a, o, n: np.clip(np.ceil(a - 0.5).astype(np.int64) - o, 0, n)
        high = lambda a, o, n: np.clip(np.floor(a - 0.5).astype(np.int64) - o + 1, 0, n)
        return low(ly0, self.r0, rows), high(ly1, self.r0, rows), low(lx0, self.c0, cols), high(lx1, self.c0, cols)


def chunks(order: np.ndarray, area: np.ndarray, most: int = 1 << 17):
    """order in pieces whose number times largest area stays under most, one at least."""
    k = 0
    while k < len(order):
        n = max(1, min(len(order) - k, int(most // max(1, area[order[k]]))))
        yield order[k : k + n]
        k += n

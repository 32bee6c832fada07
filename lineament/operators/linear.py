"""Segments, splits, samples, transects, widths and rings of polylines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineament.functions import geo
from lineament.operators import homes
from lineament.operators.spatial_join import bbox_join, bbox_outer, maximal_boxes


def segments(vertices: DataFrame, *carry: str) -> DataFrame:
    """(line_id, seg, x1, y1, x2, y2): neighbouring vertices; lines of one vertex have none."""
    w = Window.partitionBy("line_id").orderBy("seq")
    nxt = vertices.select("line_id", F.col("seq").alias("seg"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), *carry)
    return nxt.filter("x2 is not null")


def vertex_triples(vertices: DataFrame) -> DataFrame:
    """(line_id, seq, x0, y0, x, y, x2, y2) of interior vertices."""
    w = Window.partitionBy("line_id").orderBy("seq")
    out = vertices.select("line_id", "seq", F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"), "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return out.filter("x0 is not null and x2 is not null")


def transects(triples: DataFrame, offset: float = 20.0) -> DataFrame:
    """Each interior vertex's transect (ax, ay)-(bx, by): of length offset (also as span), along the bisector of its two segments."""
    to_head = F.atan2(F.col("y0") - F.col("y"), F.col("x0") - F.col("x"))
    to_tail = F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x"))
    turn = (to_head + to_tail) / 2
    dx, dy = F.cos(turn) * offset / 2, F.sin(turn) * offset / 2
    return triples.select("line_id", "seq", (F.col("x") + dx).alias("ax"), (F.col("y") + dy).alias("ay"), (F.col("x") - dx).alias("bx"), (F.col("y") - dy).alias("by"), F.lit(float(offset)).alias("span"))


def transect_widths(cuts: DataFrame, boxes: DataFrame) -> DataFrame:
    """(line_id, seq, width): the longest part of each transect (with its length, span) inside one box, 0 where it meets none.

    A box inside another one can't hold the longest part, so the largest boxes
    alone are met.  The length is the one that the transect was made with: told
    from its ends it is off in its last digit, and so is the bin of a width.
    """
    sides = {"lx0": F.least("ax", "bx"), "ly0": F.least("ay", "by"), "lx1": F.greatest("ax", "bx"), "ly1": F.greatest("ay", "by")}
    met = bbox_outer(cuts.withColumns(sides), maximal_boxes(boxes))
    t0, t1 = geo.clip_interval(*(F.col(k) for k in ("ax", "ay", "bx", "by", "x0", "y0", "x1", "y1")))
    w = F.when(F.col("x0").isNotNull(), F.greatest(t1 - t0, F.lit(0.0)) * F.col("span"))
    return met.groupBy("line_id", "seq").agg(F.coalesce(F.max(w), F.lit(0.0)).alias("width"))


def width_stats(widths: DataFrame, least: float = 1e-6, fallback: float = 5.0) -> DataFrame:
    """(line_id, avg_width, max_width): the 40th and 90th percentiles of widths that aren't zero; fallback where none is."""
    ok = F.when(F.col("width") > least, F.col("width"))
    return widths.groupBy("line_id").agg(F.coalesce(F.percentile(ok, F.lit(0.4)), F.lit(fallback)).alias("avg_width"), F.coalesce(F.percentile(ok, F.lit(0.9)), F.lit(fallback)).alias("max_width"))


def width_histogram(widths: DataFrame, bins: int = 10, least: float = 1e-6) -> DataFrame:
    """(line_id, bin, n, mid): equal-width bins from a line's least to its largest width; the last bin is closed.

    Widths that are all alike fall in one bin of half a unit to either side.
    """
    ok = widths.filter(F.col("width") > least)
    own = Window.partitionBy("line_id")
    lo, hi = F.min("width").over(own), F.max("width").over(own)
    ok = ok.select("line_id", "width", F.when(hi > lo, lo).otherwise(lo - 0.5).alias("lo"), F.when(hi > lo, hi).otherwise(hi + 0.5).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    binned = ok.withColumn("bin", F.least(F.floor((F.col("width") - F.col("lo")) / step), F.lit(bins - 1)).cast("int"))
    return binned.groupBy("line_id", "bin").agg(F.count("*").alias("n"), F.first(F.col("lo") + (F.col("bin") + 0.5) * step).alias("mid"))


def measured(vertices: DataFrame) -> DataFrame:
    """segments() with d, at, end and total: a segment's length, where it starts and ends along its line, and the line's length.

    One shuffle by line; lines of no length are left out.
    """
    w = Window.partitionBy("line_id").orderBy("seg")
    s = segments(vertices).withColumn("d", F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2))
    s = s.withColumn("end", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.coalesce(F.lag("end").over(w), F.lit(0.0)))
    s = s.withColumn("total", F.max("end").over(Window.partitionBy("line_id"))).withColumn("last", F.lead("seg").over(w).isNull())
    return s.filter("total > 0")


def _along(distance: Column) -> tuple[Column, Column]:
    t = F.least(F.greatest(F.coalesce(F.try_divide(distance - F.col("at"), F.col("d")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.col("x1") + t * (F.col("x2") - F.col("x1")), F.col("y1") + t * (F.col("y2") - F.col("y1"))


def _range(low: Column, high: Column) -> Column:
    """Whole numbers from low up to high, none if high is less."""
    return F.explode(F.when(high >= low, F.sequence(low, high)))


def at_shares(m: DataFrame, step: Column, count: Column) -> DataFrame:
    """(line_id, k, x, y): the points k * step along each line, k below count; the last one is put on the line's end at most."""
    low, high = F.ceil(F.col("at") / step), F.when(F.col("last"), count - 1).otherwise(F.least(F.ceil(F.col("end") / step), count) - 1)
    x, y = _along(F.col("k") * step)
    return m.withColumn("k", _range(low.cast("long"), high.cast("long"))).select("line_id", "k", x.alias("x"), y.alias("y"), "total")


def midpoints(m: DataFrame) -> DataFrame:
    """(line_id, x, y): half-way along each line."""
    half = F.col("total") / 2
    x, y = _along(half)
    return m.filter((F.col("at") <= half) & ((half < F.col("end")) | F.col("last"))).select("line_id", x.alias("x"), y.alias("y"))


def samples(m: DataFrame, step: float = 1.0) -> DataFrame:
    """(line_id, k, x, y): a point every step along each line, and its last vertex after them."""
    n = F.floor(F.col("total") / step) + 1
    tail = m.filter("last").select("line_id", n.alias("k"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    return at_shares(m, F.lit(float(step)), n).drop("total").unionByName(tail)


def cut_every(m: DataFrame, distance: float) -> DataFrame:
    """(line_id, part, seg, x1, y1, x2, y2): segments cut where a new part begins, every `distance` along the line.

    A line is left whole if it is no longer, or its rest would be under 1.
    """
    d = F.lit(float(distance))
    whole = (F.col("total") <= d) | (F.col("total") % d < 1)
    low, high = F.floor(F.col("at") / d), F.greatest(F.ceil(F.col("end") / d) - 1, F.floor(F.col("at") / d))
    p = m.withColumn("part", _range(F.when(whole, 0).otherwise(low).cast("long"), F.when(whole, 0).otherwise(high).cast("long")))
    whole_part = F.when(whole, True).otherwise(False)
    (ax, ay), (bx, by) = _along(F.when(whole_part, F.col("at")).otherwise(F.greatest(F.col("at"), F.col("part") * d))), _along(F.when(whole_part, F.col("end")).otherwise(F.least(F.col("end"), (F.col("part") + 1) * d)))
    return p.select("line_id", "part", "seg", ax.alias("x1"), ay.alias("y1"), bx.alias("x2"), by.alias("y2"))


def chords(m: DataFrame, most: float) -> DataFrame:
    """(line_id, part, x1, y1, x2, y2): straight pieces between ceil(length / most) evenly spaced points, one piece fewer; one from end to end if they are under two."""
    n = F.greatest(F.ceil(F.col("total") / most), F.lit(2))
    points = at_shares(m, F.col("total") / (n - 1), n)
    w = Window.partitionBy("line_id").orderBy("k")
    return points.select("line_id", F.col("k").alias("part"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).filter("x2 is not null")


def offset_vertices(vertices: DataFrame, distance: float, mitre: float = 5.0) -> DataFrame:
    """(line_id, seq, part, x, y): lines moved `distance` to their left (right, if negative), their corners mitred.

    A corner that would lie farther off than `mitre` times the distance gives
    the two ends of its moved segments.  Vertices that repeat the one before
    count once; lines of one place have no vertex.
    """
    w = Window.partitionBy("line_id").orderBy("seq")
    own = vertices.select("line_id", "seq", "x", "y", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py")).filter("px is null or px <> x or py <> y")
    n = own.select("line_id", "seq", "x", "y", *(f(c).over(w).alias(k + c) for k, f in (("p", F.lag), ("n", F.lead)) for c in ("x", "y"))).filter("px is not null or nx is not null")
    unit = lambda dx, dy: (-dy / F.sqrt(dx * dx + dy * dy), dx / F.sqrt(dx * dx + dy * dy))
    (ax, ay), (bx, by) = unit(F.col("x") - F.col("px"), F.col("y") - F.col("py")), unit(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    n = n.withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by}).withColumn("k", 1 + F.col("ax") * F.col("bx") + F.col("ay") * F.col("by"))
    spot = lambda ux, uy: F.struct((F.col("x") + distance * ux).alias("x"), (F.col("y") + distance * uy).alias("y"))
    before, after = spot(F.col("ax"), F.col("ay")), spot(F.col("bx"), F.col("by"))
    corner = spot((F.col("ax") + F.col("bx")) / F.col("k"), (F.col("ay") + F.col("by")) / F.col("k"))
    points = F.when(F.col("px").isNull(), F.array(after)).when(F.col("nx").isNull(), F.array(before)).when((F.col("k") > 0) & (F.try_divide(F.lit(2.0), F.col("k")) <= mitre * mitre), F.array(corner)).otherwise(F.array(before, after))
    return n.select("line_id", "seq", F.posexplode(points).alias("part", "p")).select("line_id", "seq", "part", "p.x", "p.y")


def rings(cells: DataFrame, segs: DataFrame, n: int = 15, width: float = 1.0) -> DataFrame:
    """(line_id, side, ring, z) of cells within n rings of a line: the ring and side of its nearest segment.

    side is 1 left, -1 right; a cell counts once for a line, ties go to the
    earlier segment, and cells on the line's own course belong to no side.
    """
    reach = n * width
    sides = {"lx0": F.least("x1", "x2") - reach, "ly0": F.least("y1", "y2") - reach, "lx1": F.greatest("x1", "x2") + reach, "ly1": F.greatest("y1", "y2") + reach}
    spots = cells.filter("z is not null").select("r", "c", "z", (F.col("c") + 0.5).alias("px"), (F.col("r") + 0.5).alias("py"))
    met = bbox_join(segs.withColumns(sides), spots, rb=("px", "py", "px", "py"))
    c = [F.col(k) for k in ("px", "py", "x1", "y1", "x2", "y2")]
    near = met.withColumn("d", geo.point_segment(*c)).filter(F.col("d") < reach)
    best = near.groupBy("line_id", "r", "c").agg(F.min_by(F.struct(F.col("d"), geo.side(*c).alias("side"), F.col("z")), F.struct(F.round("d", 9), F.col("seg"))).alias("m"))
    return best.select("line_id", F.col("m.side").alias("side"), F.floor(F.col("m.d") / width).cast("int").alias("ring"), F.col("m.z").alias("z")).filter("side <> 0")


def ring_medians(ringed: DataFrame) -> DataFrame:
    """(line_id, side, ring, median)."""
    return ringed.groupBy("line_id", "side", "ring").agg(F.percentile("z", F.lit(0.5)).alias("median"))


def _ringed_lines(segs: DataFrame, reach: float) -> DataFrame:
    """(line_id, s, bounds): each line's segments in order, and its bounds grown by reach."""
    s = segs.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seg", "x1", "y1", "x2", "y2"))).alias("s"), *(f(g(*p)).alias(k) for k, f, g, p in (("lx0", F.min, F.least, ("x1", "x2")), ("ly0", F.min, F.least, ("y1", "y2")), ("lx1", F.max, F.greatest, ("x1", "x2")), ("ly1", F.max, F.greatest, ("y1", "y2")))))
    return s.select("line_id", "s", *((F.col(k) + (reach if k[2] == "1" else -reach)).alias(k) for k in homes.BOUNDS))


def medians_of_window(table: pa.Table, window: homes.Window, n: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(medians, there) by line, side (left, right) and ring of the lines of a table (s, bounds) over a window: what rings() and ring_medians() give."""
    reach = n * width
    s = table.column("s").combine_chunks()
    off, flat = s.offsets.to_numpy(), s.flatten()
    lo = off[:-1] - off[0]
    many = np.diff(off)
    ends = [np.asarray(flat.field(k).to_numpy(zero_copy_only=False), float) for k in ("x1", "y1", "x2", "y2")]
    i0, i1, j0, j1 = window.spans(*(table.column(k).to_numpy() for k in homes.BOUNDS))
    high, wide = np.maximum(i1 - i0, 0), np.maximum(j1 - j0, 0)
    values = np.sort(window.v[~np.isnan(window.v)])
    full = ~np.isnan(window.v)
    rank = np.zeros(window.v.shape, np.int64)
    rank[full] = np.searchsorted(values, window.v[full])
    out, there = np.full((len(many), 2 * n), np.nan), np.zeros((len(many), 2 * n), bool)
    order = np.lexsort((wide, high, many))[::-1]
    order = order[(high[order] > 0) & (wide[order] > 0)]
    area = np.maximum.accumulate(high[order[::-1]])[::-1] * np.maximum.accumulate(wide[order[::-1]])[::-1]
    by_line = np.zeros(len(many), np.int64)
    by_line[order] = area
    for own in homes.chunks(order, by_line):
        h, w, b = int(high[own].max()), int(wide[own].max()), len(own)
        rows, cols = i0[own, None] + np.arange(h), j0[own, None] + np.arange(w)
        seen = (rows < i1[own, None])[:, :, None] & (cols < j1[own, None])[:, None, :]
        rows, cols = np.minimum(rows, full.shape[0] - 1), np.minimum(cols, full.shape[1] - 1)
        seen &= full[rows[:, :, None], cols[:, None, :]]
        px, py = (cols + window.c0 + 0.5)[:, None, :], (rows + window.r0 + 0.5)[:, :, None]
        least, away, which = np.full((b, h, w), np.inf), np.full((b, h, w), np.inf), np.zeros((b, h, w), np.int64)
        for k in range(int(many[own].max())):
            at = lo[own] + np.minimum(k, many[own] - 1)  # a line without that segment meets its last one again, which changes nothing
            x1, y1, x2, y2 = (e[at][:, None, None] for e in ends)
            dx, dy = x2 - x1, y2 - y1
            size = dx * dx + dy * dy
            t = (px - x1) * dx + (py - y1) * dy
            t /= np.where(size == 0, 1.0, size)
            np.clip(t, 0.0, 1.0, out=t)
            d = px - x1 - t * dx
            d *= d
            t *= dy
            t = py - y1 - t
            t *= t
            d += t
            np.sqrt(d, out=d)
            rounded = np.rint(d * 1e9)
            near = rounded < least  # of equals the earlier segment
            np.copyto(least, rounded, where=near)
            np.copyto(away, d, where=near)
            np.copyto(which, k, where=near)
        at = lo[own][:, None, None] + np.minimum(which, many[own][:, None, None] - 1)
        x1, y1, x2, y2 = (e[at] for e in ends)
        side = np.sign((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1))
        seen &= (away < reach) & (side != 0)
        line, i, j = np.nonzero(seen)
        group = (line * 2 + (side[line, i, j] < 0)) * n + np.minimum(away[line, i, j] // width, n - 1).astype(np.int64)
        key = np.sort(group * (len(values) + 1) + rank[rows[line, i], cols[line, j]])
        count = np.bincount(group, minlength=b * 2 * n)
        first = np.cumsum(count) - count
        has = count > 0
        lower, upper = (values[key[(first + k)[has]] % (len(values) + 1)] for k in ((count - 1) // 2, count // 2))
        m = np.full(b * 2 * n, np.nan)
        m[has] = np.where(lower == upper, lower, 0.5 * lower + 0.5 * upper)
        out[own], there[own] = m.reshape(b, 2 * n), has.reshape(b, 2 * n)
    return out.reshape(-1, 2, n), there.reshape(-1, 2, n)


def line_ring_medians(cells: DataFrame, segs: DataFrame, n: int = 15, width: float = 1.0) -> DataFrame:
    """ring_medians() of rings(), by tiles: no row is made for a line and a cell.  Only lines larger than the largest tile go through rings()."""
    near, far = homes.split(_ringed_lines(segs, n * width))
    schema = pa.schema([("line_id", pa.int64()), ("side", pa.int32()), ("ring", pa.int32()), ("median", pa.float64())])

    def kernel(table: pa.Table, window: homes.Window) -> dict:
        medians, there = medians_of_window(table, window, n, width)
        line, side, ring = np.nonzero(there)
        return {"line_id": table.column("line_id").to_numpy()[line], "side": (1 - 2 * side).astype(np.int32), "ring": ring.astype(np.int32), "median": medians[there]}

    out = homes.by_homes(near, cells.select("r", "c", F.col("z").alias("v")), kernel, "line_id long, side int, ring int, median double", schema)
    return out if far is None else out.unionByName(ring_medians(rings(cells, _segments_of(far), n, width)))


def _segments_of(lines: DataFrame) -> DataFrame:
    return lines.select("line_id", F.explode("s").alias("s")).select("line_id", "s.*")


#: Rates of change tried, largest first; a repeated subtraction of 0.1 stops short of 1.1.
RATES = (1.5, 1.4, 1.3, 1.2)


def first_change(medians: DataFrame, n: int) -> DataFrame:
    """(line_id, side, cut_dist, cut_ht): where the rings' medians first jump, or what their median stands for.

    A ring counts if its median is 0.5 at least and exceeds the ring before's by
    a rate; the largest rate that any ring but the last reaches decides, and its
    first ring.  Rings without cells break the chain.
    """
    w = Window.partitionBy("line_id", "side").orderBy("ring")
    d = medians.withColumn("before", F.when(F.lag("ring").over(w) == F.col("ring") - 1, F.lag("median").over(w))).withColumn("rise", F.when(F.col("ring") == 0, 0.0).otherwise(F.col("median") - F.col("before")))
    hit = F.when((F.col("median") >= 0.5) & (F.col("ring") < n - 1), F.col("rise"))
    tries = [F.min(F.when(hit >= t - 1e-9, F.struct("ring", "median"))).alias(f"t{k}") for k, t in enumerate(RATES)]
    agg = d.groupBy("line_id", "side").agg(*tries, F.percentile("median", F.lit(0.5)).alias("m")).withColumn("f", F.coalesce(*(f"t{k}" for k in range(len(RATES)))))
    ht, dist = F.floor("f.median").cast("double"), (F.col("f.ring") + 1).cast("double")
    found_ht = F.when((ht <= 0.5) & (dist > 5), 2.0).when((ht > 15) & (dist > 4), 15.5).otherwise(ht)
    m = F.col("m")
    rest_d = F.when(m <= 0.5, 4.0).when(m <= 5, 4.5).when(m <= 10, 5.5).when(m <= 15, 6.0).otherwise(5.0)
    rest_h = F.when(m <= 0.5, 0.5).when(m <= 15, F.floor(m).cast("double")).otherwise(15.5)
    return agg.select("line_id", "side", F.when(F.col("f").isNotNull(), dist).otherwise(rest_d).alias("cut_dist"), F.when(F.col("f").isNotNull(), found_ht).otherwise(rest_h).alias("cut_ht"))


def thresholds_of_medians(medians: np.ndarray, there: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cut_dist, cut_ht, th) by line and side, as first_change() has them, nan for sides without cells."""
    n = medians.shape[2]
    rise = np.full(medians.shape, np.nan)
    rise[:, :, 0] = 0.0
    rise[:, :, 1:] = np.where(there[:, :, :-1], medians[:, :, 1:] - medians[:, :, :-1], np.nan)
    with np.errstate(invalid="ignore"):
        may = there & (medians >= 0.5) & (np.arange(n) < n - 1)
        found, ring = np.zeros(medians.shape[:2], bool), np.zeros(medians.shape[:2], np.int64)
        for t in RATES:
            hit = may & (rise >= t - 1e-9)
            new = hit.any(2) & ~found
            ring = np.where(new, hit.argmax(2), ring)
            found |= new
    some = there.any(2)
    inner = np.sort(np.where(there, medians, np.inf), axis=2)
    count = there.sum(2)
    pick = lambda k: np.take_along_axis(inner, np.maximum(k, 0)[:, :, None], 2)[:, :, 0]
    m = np.where(some, 0.5 * pick((count - 1) // 2) + 0.5 * pick(np.minimum(count // 2, n - 1)), np.nan)
    with np.errstate(invalid="ignore"):
        ht, dist = np.floor(np.take_along_axis(medians, ring[:, :, None], 2)[:, :, 0]), ring + 1.0
        ht = np.where((ht <= 0.5) & (dist > 5), 2.0, np.where((ht > 15) & (dist > 4), 15.5, ht))
        rest_d = np.select([m <= 0.5, m <= 5, m <= 10, m <= 15], [4.0, 4.5, 5.5, 6.0], 5.0)
        rest_h = np.select([m <= 0.5, m <= 15], [0.5, np.floor(m)], 15.5)
        th = np.where(m > 1, m * factor, 1.0)
    return tuple(np.where(some, v, np.nan) for v in (np.where(found, dist, rest_d), np.where(found, ht, rest_h), th))


_THRESHOLDS = ("CL_CutHt", "CR_CutHt", "LDist_Cut", "RDist_Cut", "DynCanTh")


def relative_thresholds(cells: DataFrame, segs: DataFrame, n: int = 15, width: float = 1.0, factor: float = 0.3) -> DataFrame:
    """(line_id, CL_CutHt, CR_CutHt, LDist_Cut, RDist_Cut, DynCanTh) of lines with cells in a ring.

    DynCanTh is the mean of the sides' median of ring medians times factor where
    that is over 1, else 1; a side without cells has none.  Lines that a tile
    holds are done where their medians are made, one row a line.
    """
    near, far = homes.split(_ringed_lines(segs, n * width))
    schema = pa.schema([("line_id", pa.int64()), *((c, pa.float64()) for c in _THRESHOLDS)])

    def kernel(table: pa.Table, window: homes.Window) -> dict:
        medians, there = medians_of_window(table, window, n, width)
        ok = there.any((1, 2))
        dist, ht, th = (v[ok] for v in thresholds_of_medians(medians, there, factor))
        mean = np.where(np.isnan(th), 0.0, th).sum(1) / (~np.isnan(th)).sum(1)
        out = {"line_id": table.column("line_id").to_numpy()[ok]}
        for c, v in zip(_THRESHOLDS, (ht[:, 0], ht[:, 1], dist[:, 0], dist[:, 1], mean)):
            out[c] = pa.array(v, mask=np.isnan(v))
        return out

    out = homes.by_homes(near, cells.select("r", "c", F.col("z").alias("v")), kernel, "line_id long, " + ", ".join(f"{c} double" for c in _THRESHOLDS), schema)
    if far is None:
        return out
    med = ring_medians(rings(cells, _segments_of(far), n, width))
    cut = first_change(med, n)
    th = med.groupBy("line_id", "side").agg(F.percentile("median", F.lit(0.5)).alias("p")).withColumn("th", F.when(F.col("p") > 1, F.col("p") * factor).otherwise(1.0))
    both = cut.join(th, ["line_id", "side"])
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return out.unionByName(both.groupBy("line_id").agg(pick(1, "cut_ht").alias("CL_CutHt"), pick(-1, "cut_ht").alias("CR_CutHt"), pick(1, "cut_dist").alias("LDist_Cut"), pick(-1, "cut_dist").alias("RDist_Cut"), F.avg("th").alias("DynCanTh")))

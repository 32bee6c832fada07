"""Filter-and-refine joins: grid buckets make an equi-join, exact tests follow.

Neither side is broadcast by force: buckets are hash partitions that adaptive
execution can split, and a shape is in as many buckets as its bounds touch.  A
pair that meets in several buckets is kept in the bucket of the larger of the two
lower corners alone, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineament.functions import geo
from lineament.plans.storage import partitions, sized, written

CELL = 10.0


def _bucket(c: Column, cell: float) -> Column:
    return F.floor(c / cell).cast("long")


def _dealt(df: DataFrame, x0: str, y0: str, x1: str, y1: str, tag: str, cell: float) -> DataFrame:
    spans = [F.explode(F.sequence(_bucket(F.col(a), cell), _bucket(F.col(b), cell))) for a, b in ((x0, x1), (y0, y1))]
    return df.filter(f"{x0} <= {x1} and {y0} <= {y1}").withColumn(f"__{tag}x", spans[0]).withColumn(f"__{tag}y", spans[1])


def bbox_join(left: DataFrame, right: DataFrame, lb=("lx0", "ly0", "lx1", "ly1"), rb=("x0", "y0", "x1", "y1"), cell: float = CELL, how: str = "inner") -> DataFrame:
    """Pairs whose bounds meet, edges included; with how='left' also the left rows without any.

    The sides' column names must differ.  Rows with a null bound meet nothing.
    how='left' asks for a column __row in left that tells its rows apart.
    """
    a, b = _dealt(left, *lb, "l", cell), _dealt(right, *rb, "r", cell)
    first = lambda p, q: _bucket(F.greatest(F.col(p), F.col(q)), cell)
    on = (F.col("__lx") == F.col("__rx")) & (F.col("__ly") == F.col("__ry"))
    meet = (F.col(lb[0]) <= F.col(rb[2])) & (F.col(rb[0]) <= F.col(lb[2])) & (F.col(lb[1]) <= F.col(rb[3])) & (F.col(rb[1]) <= F.col(lb[3]))
    once = (F.col("__lx") == first(lb[0], rb[0])) & (F.col("__ly") == first(lb[1], rb[1]))
    pairs = a.join(b, on & meet & once).drop("__lx", "__ly", "__rx", "__ry")
    if how != "left":
        return pairs
    found = pairs.select("__row", *right.columns)
    return left.join(found, "__row", "left")


def bbox_outer(left: DataFrame, right: DataFrame, lb=("lx0", "ly0", "lx1", "ly1"), rb=("x0", "y0", "x1", "y1"), cell: float = CELL) -> DataFrame:
    """The pairs of bbox_join() with every row of left once more, or more often, with nulls for right: for aggregates by left row.

    Left rows aren't joined a second time, so they stay where they are if right
    is broadcast.  Rows with a null bound, or bounds the wrong way, meet nothing.
    """
    spans = [F.explode_outer(F.when(F.col(a) <= F.col(b), F.sequence(_bucket(F.col(a), cell), _bucket(F.col(b), cell)))) for a, b in ((lb[0], lb[2]), (lb[1], lb[3]))]
    a, b = left.withColumn("__lx", spans[0]).withColumn("__ly", spans[1]), sized(written(_dealt(right, *rb, "r", cell), "dealt"), 64 + 16 * len(right.columns))
    first = lambda p, q: _bucket(F.greatest(F.col(p), F.col(q)), cell)
    on = (F.col("__lx") == F.col("__rx")) & (F.col("__ly") == F.col("__ry"))
    meet = (F.col(lb[0]) <= F.col(rb[2])) & (F.col(rb[0]) <= F.col(lb[2])) & (F.col(lb[1]) <= F.col(rb[3])) & (F.col(rb[1]) <= F.col(lb[3]))
    once = (F.col("__lx") == first(lb[0], rb[0])) & (F.col("__ly") == first(lb[1], rb[1]))
    return a.join(b, on & meet & once, "left").drop("__lx", "__ly", "__rx", "__ry")


def bbox_inner(left: DataFrame, right: DataFrame, lb=("lx0", "ly0", "lx1", "ly1"), rb=("x0", "y0", "x1", "y1"), cell: float = CELL) -> DataFrame:
    """The pairs of bbox_join() with left rows where they are, as long as right, once dealt, is small enough to be sent to them."""
    dealt = written(_dealt(right, *rb, "r", cell), "dealt")
    lists = [c for c, t in dealt.dtypes if t.startswith("array")]
    size = dealt.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c) for c in lists)).first()
    total = size.n * (32 + 16 * len(right.columns)) + 8 * sum(size[c] for c in lists)
    first = lambda p, q: _bucket(F.greatest(F.col(p), F.col(q)), cell)
    on = (F.col("__lx") == F.col("__rx")) & (F.col("__ly") == F.col("__ry"))
    meet = (F.col(lb[0]) <= F.col(rb[2])) & (F.col(rb[0]) <= F.col(lb[2])) & (F.col(lb[1]) <= F.col(rb[3])) & (F.col(rb[1]) <= F.col(lb[3]))
    once = (F.col("__lx") == first(lb[0], rb[0])) & (F.col("__ly") == first(lb[1], rb[1]))
    return _dealt(left, *lb, "l", cell).join(sized(dealt, 1, total), on & meet & once).drop("__lx", "__ly", "__rx", "__ry")


def with_members(boxes: DataFrame) -> DataFrame:
    """(x0, y0, x1, y1, ids): each box once, with the ids of its copies."""
    return boxes.groupBy("x0", "y0", "x1", "y1").agg(F.collect_list("id").alias("ids"))


def overlapping_boxes(boxes: DataFrame) -> DataFrame:
    """(a, b, area), a < b: boxes that share area and of which none holds the other.

    Copies of a box are met once, and their pairs made from each two boxes that
    overlap, which are dealt by number: no bucket is one task's.
    """
    at = ["x0", "y0", "x1", "y1"]
    one = written(with_members(boxes.filter("x0 < x1 and y0 < y1").select("id", *((F.col(c) + 0).alias(c) for c in at))), "boxes")
    n = partitions(boxes.sparkSession)
    left = one.select(*(F.col(c).alias(f"l{c}") for c in at), F.col("ids").alias("own")).repartition(n)
    met = bbox_inner(left, one, cell=2 * CELL).filter("lx0 < x1 and x0 < lx1 and ly0 < y1 and y0 < ly1 and (lx0, ly0, lx1, ly1) < (x0, y0, x1, y1)")
    met = met.filter("not (lx0 <= x0 and ly0 <= y0 and lx1 >= x1 and ly1 >= y1) and not (x0 <= lx0 and y0 <= ly0 and x1 >= lx1 and y1 >= ly1)")
    met = met.select("own", "ids", F.expr("cast((least(lx1, x1) - greatest(lx0, x0)) * (least(ly1, y1) - greatest(ly0, y0)) as bigint)").alias("area"))
    pairs = met.select(F.explode("own").alias("p"), "ids", "area").select("p", F.explode("ids").alias("q"), "area")
    return pairs.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "area")


def distinct_boxes(boxes: DataFrame, least: str = "id") -> DataFrame:
    """(x0, y0, x1, y1, id, n): each box once, with the least id of its copies and how many there are."""
    return boxes.groupBy("x0", "y0", "x1", "y1").agg(F.min(least).alias(least), F.count("*").alias("n"))


def distinct_points(points: DataFrame) -> DataFrame:
    """(x, y, id, n): each place once, with the least id of its points and how many there are."""
    return points.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def counts_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(id, points): how many points (x, y, id) each box (id, ...) holds, boxes without any left out; places and boxes are met once whatever their copies."""
    places, u = distinct_points(points).select("x", "y", "n"), distinct_boxes(boxes).drop("n")
    held = points_in_boxes(places, u).groupBy("id").agg(F.sum("n").alias("points"))
    return boxes.join(u.withColumnRenamed("id", "__of"), ["x0", "y0", "x1", "y1"]).join(held.withColumnRenamed("id", "__held"), F.col("__of") == F.col("__held")).select("id", "points")


def maximal_boxes(boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """(x0, y0, x1, y1) of boxes that lie in no other, each once: all that meets, or reaches longest into, any box does so with one of these.

    Of boxes with one lower corner those inside another are told by a running
    largest y1; what is left is held against its neighbours.  The result is
    stored.
    """
    at = ["x0", "y0", "x1", "y1"]
    # zero is added, as -0.0 and 0.0 are one place
    own = boxes.select(*((F.col(c) + 0).alias(c) for c in at)).filter("x0 <= x1 and y0 <= y1").distinct()
    wider = Window.partitionBy("x0", "y0").orderBy(F.desc("x1"), F.desc("y1")).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("__top", F.max("y1").over(wider)).filter("__top is null or y1 > __top").drop("__top")
    own = written(own, "corners")
    inner = own.select(*(F.col(c).alias(f"l{c}") for c in at))
    held = bbox_join(inner, own, cell=cell).filter("x0 <= lx0 and y0 <= ly0 and x1 >= lx1 and y1 >= ly1 and (x0 < lx0 or y0 < ly0 or x1 > lx1 or y1 > ly1)")
    out = written(own.join(held.select(*(F.col(f"l{c}").alias(c) for c in at)).distinct(), at, "left_anti"), "boxes")
    return out


def points_in_boxes(points: DataFrame, boxes: DataFrame, px: str = "x", py: str = "y", bounds=("x0", "y0", "x1", "y1"), cell: float = CELL) -> DataFrame:
    """Pairs of a point and a box that contains it, lower edges in and upper edges out; a point is in one bucket."""
    dealt = _dealt(boxes, *bounds, "r", cell)
    on = (_bucket(F.col(px), cell) == F.col("__rx")) & (_bucket(F.col(py), cell) == F.col("__ry"))
    inside = (F.col(px) >= F.col(bounds[0])) & (F.col(px) < F.col(bounds[2])) & (F.col(py) >= F.col(bounds[1])) & (F.col(py) < F.col(bounds[3]))
    return points.join(dealt, on & inside).drop("__rx", "__ry")


def points_in_rings(points: DataFrame, polygons: DataFrame, px: str = "x", py: str = "y", ring: str = "ring", cell: float = CELL) -> DataFrame:
    """Pairs of a point and a polygon whose outer ring contains it; left and lower edges are in.

    The ring's edges are laid out once a polygon, and a ray is cast only where
    the bounds, which are found from the ring, contain the point: the tests are
    one expression, so the optimiser can't put the cast first.
    """
    edges = geo.pairs(F.concat(F.col(ring), F.slice(F.col(ring), 1, 1)))
    low = lambda k: F.array_min(F.transform(F.col(ring), lambda p: p[k]))
    high = lambda k: F.array_max(F.transform(F.col(ring), lambda p: p[k]))
    bounds = {"__x0": low("x"), "__y0": low("y"), "__x1": high("x"), "__y1": high("y"), "__edges": edges}
    dealt = _dealt(polygons.withColumns(bounds), "__x0", "__y0", "__x1", "__y1", "r", cell)
    x, y = F.col(px), F.col(py)
    on = (_bucket(x, cell) == F.col("__rx")) & (_bucket(y, cell) == F.col("__ry"))
    inside = F.when((x >= F.col("__x0")) & (x < F.col("__x1")) & (y >= F.col("__y0")) & (y < F.col("__y1")), geo.in_edges(x, y, F.col("__edges"))).otherwise(False)
    return points.join(dealt, on & inside).drop("__rx", "__ry", *bounds)


def near_pairs(points: DataFrame, key: str, reach: float) -> DataFrame:
    """(a, b) with a < b for points within reach in x and in y; each point meets the nine buckets about it."""
    base = points.select(F.col(key).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), _bucket(F.col("x"), reach).alias("gx"), _bucket(F.col("y"), reach).alias("gy"))
    around = F.expr("sequence(-1, 1)")
    other = points.select(F.col(key).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.transform(around, lambda i: _bucket(F.col("x"), reach) + i)).alias("gx"), _bucket(F.col("y"), reach).alias("y0"))
    other = other.withColumn("gy", F.explode(F.transform(around, lambda i: F.col("y0") + i))).drop("y0")
    return base.join(other, ["gx", "gy"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("ax") - F.col("bx")) < reach) & (F.abs(F.col("ay") - F.col("by")) < reach)).select("a", "b", "ax", "ay", "bx", "by")


def near_places(points: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (place, id) of points, a place being named by its least id, and near_pairs() of places; a point without one is its own."""
    places = written(points.filter("x is not null and y is not null").groupBy("x", "y").agg(F.min("id").alias("place")), "places")
    return points.select("x", "y", "id").join(places, ["x", "y"], "left").select(F.coalesce("place", "id").alias("place"), "id"), near_pairs(places, "place", reach)

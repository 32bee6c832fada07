"""Point-cloud aggregates over grid pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (30, 40, 50, 60, 70, 80, 90, 99)


def pixel(points: DataFrame, res: float) -> DataFrame:
    return points.withColumn("px", F.floor(F.col("x") / res).cast("long")).withColumn("py", F.floor(F.col("y") / res).cast("long"))


def las_filter(points: DataFrame, drop_class: int | None = 7, low: float | None = 0.0, high: float | None = None) -> DataFrame:
    """Returns without a class and outside of a height range left out; a null class stays."""
    if drop_class is not None:
        points = points.filter(F.coalesce(F.col("cls") != drop_class, F.lit(True)))
    if low is not None:
        points = points.filter(F.col("z") >= low)
    return points if high is None else points.filter(F.col("z") <= high)


def height_metrics(points: DataFrame, res: float) -> DataFrame:
    """(px, py, zmax, zmin, zsd, zq30 .. zq99): sample deviation, linear quantiles."""
    qs = F.percentile("z", F.array(*(F.lit(q / 100) for q in LEVELS)))
    out = pixel(points, res).groupBy("px", "py").agg(F.max("z").alias("zmax"), F.min("z").alias("zmin"), F.stddev_samp("z").alias("zsd"), qs.alias("q"))
    return out.select("px", "py", "zmax", "zmin", "zsd", *(F.col("q")[k].alias(f"zq{q}") for k, q in enumerate(LEVELS)))


def share(points: DataFrame, res: float, condition: Column, name: str) -> DataFrame:
    """(px, py, total, hits, name): the share of a pixel's returns for which condition holds."""
    return pixel(points, res).groupBy("px", "py").agg(F.count("*").alias("total"), F.count_if(condition).alias("hits")).withColumn(name, F.col("hits") / F.col("total"))


def density(points: DataFrame, res: float) -> DataFrame:
    """(px, py, density): returns per unit of area."""
    return pixel(points, res).groupBy("px", "py").agg((F.count("*") / (res * res)).alias("density"))


def cell_size(per_area: Column) -> Column:
    """round(0.05 * round(sqrt(3 / density) / 0.05), 2)."""
    return F.round(0.05 * F.round(F.sqrt(3 / per_area) / 0.05), 2)


def gap_fraction(total: DataFrame, ground: DataFrame, angle: float) -> DataFrame:
    """(px, py, lpi, elai) from densities; pixels without ground returns have neither."""
    both = total.select("px", "py", F.col("density").alias("t")).join(ground.select("px", "py", F.col("density").alias("g")), ["px", "py"], "left")
    lpi = F.try_divide(F.col("g"), F.col("t"))
    return both.select("px", "py", lpi.alias("lpi"), (-F.cos(F.radians(F.lit(angle / 2))) / 0.5 * F.ln(lpi)).alias("elai"))


def ground_height(points: DataFrame, at: DataFrame, k: int = 3, reach: float = 5.0, power: float = 2.0) -> DataFrame:
    """at (id, x, y) with the inverse-distance mean of the k nearest ground returns within reach; null without one."""
    g = points.filter("cls = 2").groupBy(F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz")).agg(F.count("*").alias("n"))
    # of one place's returns the k lowest are enough, as it orders equals by height
    low = Window.partitionBy("gx", "gy").orderBy("gz").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("before", F.coalesce(F.sum("n").over(low), F.lit(0))).filter(F.col("before") < k).withColumn("n", F.least("n", k - F.col("before"))).drop("before")
    g = g.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n", "one")
    b = lambda c: F.floor(F.col(c) / reach).cast("long")
    g = g.withColumn("bx", b("gx")).withColumn("by", b("gy"))
    around = lambda c: F.explode(F.transform(F.expr("sequence(-1, 1)"), lambda i: F.floor(F.col(c) / reach).cast("long") + i))
    places = at.select("x", "y").distinct()  # what stands on one place has one height
    near = places.withColumn("bx", around("x")).withColumn("by", around("y")).join(g, ["bx", "by"])
    near = near.withColumn("d", F.sqrt((F.col("x") - F.col("gx")) ** 2 + (F.col("y") - F.col("gy")) ** 2)).filter(F.col("d") <= reach)
    top = near.withColumn("k", F.row_number().over(Window.partitionBy("x", "y").orderBy("d", "gz", "gx", "gy"))).filter(F.col("k") <= k)
    w = 1 / F.pow(F.greatest("d", F.lit(1e-6)), F.lit(power))
    found = top.groupBy("x", "y").agg((F.sum(w * F.col("gz")) / F.sum(w)).alias("ground"))
    return at.join(found, ["x", "y"], "left").select(*at.columns, "ground")


def tree_tops(cells: DataFrame, window: Column, least: float, most: int) -> DataFrame:
    """(r, c, z) of cells over `least` that no cell within half their window exceeds; of equals the one of the least (r, c) stands.

    window is in cells, from z; `most` bounds its half in cells.
    """
    from lineament.operators.raster import TILED, by_tiles, disc, shifted, spread

    tall = cells.filter(F.col("z") > least)
    if len(disc(most)) > TILED:
        spots = [o for o in disc(most) if o[2]]

        def kernel(there, columns, r0, c0, core) -> pd.DataFrame:
            z, half = np.where(there, columns["z"], -np.inf), columns["half"]
            beaten = np.zeros(z.shape, bool)
            for i, j, d in spots:
                other = shifted(z, i, j, -np.inf)
                beaten |= (d <= half) & ((other > z) | ((other == z) & ((i, j) < (0, 0))))
            rr, cc = np.nonzero((there & ~beaten)[core, core])
            return pd.DataFrame({"r": rr + r0 + most, "c": cc + c0 + most, "z": z[core, core][rr, cc]})

        return by_tiles(tall.select("r", "c", "z", (window / 2).cast("double").alias("half")), most, kernel, "r long, c long, z double")
    seen = spread(tall.select("r", "c", "z"), disc(most)).filter("not (i = 0 and j = 0)").select("r", "c", F.struct("v", (-F.col("r") - F.col("i")).alias("nr"), (-F.col("c") - F.col("j")).alias("nc")).alias("other"), "d")
    own = tall.select("r", "c", "z", (window / 2).alias("half"))
    beaten = seen.join(own, ["r", "c"]).filter((F.col("d") <= F.col("half")) & (F.col("other") > F.struct(F.col("z").alias("v"), (-F.col("r")).alias("nr"), (-F.col("c")).alias("nc"))))
    return tall.select("r", "c", "z").join(beaten.select("r", "c").distinct(), ["r", "c"], "left_anti")


def point_tops(points: DataFrame, window: Column, least: float, most: float) -> DataFrame:
    """(id, x, y, h) of points over `least` that no higher point (then lesser id) within half their window exceeds."""
    tall = points.filter(F.col("h") > least).withColumn("half", window / 2)
    b = lambda c: F.floor(F.col(c) / most).cast("long")
    other = tall.select(F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("h").alias("oh"), b("x").alias("bx"), b("y").alias("by"))
    around = lambda c: F.explode(F.transform(F.expr("sequence(-1, 1)"), lambda i: F.floor(F.col(c) / most).cast("long") + i))
    beaten = tall.withColumn("bx", around("x")).withColumn("by", around("y")).join(other, ["bx", "by"])
    beaten = beaten.filter((F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2) <= F.col("half")) & ((F.col("oh") > F.col("h")) | ((F.col("oh") == F.col("h")) & (F.col("oid") < F.col("id")))))
    return tall.drop("half").join(beaten.select("id").distinct(), "id", "left_anti")


def _quality(value: Column, lo: Column, hi: Column, low_share: float, high_share: float) -> Column:
    span = hi - lo
    return F.coalesce(F.when(value <= span * low_share, 1.0).when(value > span * high_share, 0.0).otherwise(1 - F.try_divide(value - lo, span)), F.lit(0.0))


def conductivity(terrain: DataFrame, canopy: DataFrame, intensity: DataFrame, ground: DataFrame, low: DataFrame) -> DataFrame:
    """(px, py, conduct, cost) from pixels of (slope, roughness, edge), chm, irange, gpd and lower density.

    The ranges and low quantiles are taken over each whole surface by one-row
    aggregates.  Pixels without a surface count 0 for it.
    """
    rows = terrain
    for other in (canopy, intensity, ground, low):
        rows = rows.join(other, ["px", "py"], "left")
    rows = rows.withColumn("irange", F.coalesce("irange", F.lit(0.0)))
    names = ("slope", "roughness", "edge", "chm", "irange", "gpd", "lower")
    ends = rows.agg(*(f(n).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))), F.percentile("irange", F.lit(0.05)).alias("iq"), F.percentile("gpd", F.lit(0.02)).alias("gq"), F.percentile("lower", F.lit(0.02)).alias("lq")).first()
    end = lambda n: (F.lit(ends[f"lo_{n}"]).cast("double"), F.lit(ends[f"hi_{n}"]).cast("double"))
    q = {n: _quality(F.col(n), *end(n), a, b) for n, a, b in (("slope", 0.1, 0.75), ("roughness", 0.1, 0.8), ("edge", 0.15, 0.85), ("chm", 0.1, 0.75))}
    lo, hi = end("irange")
    qint = F.when(F.col("irange") <= ends["iq"], 1.0).when(F.col("irange") > (hi - lo) * 0.75, 0.0).otherwise(1 - F.try_divide(F.col("irange") - lo, hi - lo))
    lo, hi = end("gpd")
    qgpd = F.coalesce(F.when(F.col("gpd") <= F.lit(ends["gq"]), 0.0).otherwise(F.try_divide(F.col("gpd") - lo, hi - lo)), F.lit(0.0))
    qlow = F.coalesce(F.when(F.col("lower") > F.lit(ends["lq"]), 0.0).otherwise(1.0), F.lit(0.0))
    rows = rows.withColumn("conduct", q["slope"] * qlow * q["edge"] * 0.25 * (q["chm"] + qgpd + q["roughness"] + F.coalesce(qint, F.lit(0.0))))
    top = rows.agg(F.max("conduct").alias("m")).first()["m"]
    return rows.select("px", "py", "conduct", (F.lit(top) - F.col("conduct")).alias("cost"))

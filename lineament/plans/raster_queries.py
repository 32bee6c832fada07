"""Queries over raster cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineament.operators import linear, paths, raster
from lineament.operators.spatial_join import points_in_boxes
from lineament.plans.registry import query
from lineament.sources import views
from lineament.sources.views import with_views

_IN = "c + 0.5 >= x0 AND c + 0.5 < x1 AND r + 0.5 >= y0 AND r + 0.5 < y1"


def _zonal(spark, sf_dir):
    spots = views.cells(spark, sf_dir).select("r", "c", "z", (F.col("c") + 0.5).alias("px"), (F.col("r") + 0.5).alias("py"))
    return points_in_boxes(spots, views.boxes(spark, sf_dir), "px", "py")


@query(
    with_views(
        f"SELECT id, count(*) AS n_cells, count(z) AS n_valid, round(avg(z), 6) AS avg_height, round(sum(z), 5) AS volume, round(sqrt(power(avg(z), 2) + var_pop(z) * (count(z) - 1) / count(z)), 6) AS roughness FROM v_boxes JOIN v_cells ON {_IN} GROUP BY id HAVING count(z) > 0",
        "v_boxes",
        "v_cells",
    )
)
def a03_height_attributes(spark, sf_dir):
    """Cells of each polygon by the centre rule, and their height attributes (S05, J11, A03; rasters of T12)."""
    z, n = F.col("z"), F.count("z")
    out = _zonal(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n_cells"), n.alias("n_valid"), F.round(F.avg(z), 6).alias("avg_height"), F.round(F.sum(z), 5).alias("volume"), F.round(F.sqrt(F.avg(z) ** 2 + F.var_pop(z) * (n - 1) / n), 6).alias("roughness"))
    return out.filter("n_valid > 0")


@query(with_views(f"SELECT id, round(avg(z), 6) AS zon_mean, round(min(z) + power(avg(z) / 28, 2) * (max(z) - min(z)), 6) AS corridor_th FROM v_boxes JOIN v_cells ON {_IN} GROUP BY id HAVING count(z) > 0", "v_boxes", "v_cells"))
def t11_zonal_threshold(spark, sf_dir):
    """Zonal mean and the corridor threshold that it gives."""
    out = _zonal(spark, sf_dir).groupBy("id").agg(F.avg("z").alias("m"), F.min("z").alias("lo"), F.max("z").alias("hi")).filter("m is not null")
    return out.select("id", F.round("m", 6).alias("zon_mean"), F.round(F.col("lo") + (F.col("m") / 28) ** 2 * (F.col("hi") - F.col("lo")), 6).alias("corridor_th"))


@query(with_views("SELECT count(*) AS n_cells, count(z) AS n_valid, min(r) FILTER (WHERE z IS NOT NULL) AS r0, max(r) FILTER (WHERE z IS NOT NULL) AS r1, min(c) FILTER (WHERE z IS NOT NULL) AS c0, max(c) FILTER (WHERE z IS NOT NULL) AS c1, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max FROM v_cells", "v_cells"))
def s17_data_extent(spark, sf_dir):
    """A raster's metadata and the extent of its data."""
    ok = F.col("z").isNotNull()
    ends = [f(F.when(ok, F.col(k))).alias(n) for f, k, n in ((F.min, "r", "r0"), (F.max, "r", "r1"), (F.min, "c", "c0"), (F.max, "c", "c1"))]
    return views.cells(spark, sf_dir).agg(F.count("*").alias("n_cells"), F.count("z").alias("n_valid"), *ends, F.round(F.min("z"), 6).alias("z_min"), F.round(F.max("z"), 6).alias("z_max"))


@query(with_views("SELECT CAST(floor(r / 30) AS BIGINT) AS tr, CAST(floor(c / 30) AS BIGINT) AS tc, count(z) AS n_valid, round(avg(z), 6) AS mean FROM v_cells GROUP BY 1, 2 HAVING count(z) > 0", "v_cells"))
def s19_tiles(spark, sf_dir):
    """Cells clipped to tiles of 30, empty tiles left out: the batch's task list."""
    t = lambda k: F.floor(F.col(k) / 30).cast("long")
    return views.cells(spark, sf_dir).groupBy(t("r").alias("tr"), t("c").alias("tc")).agg(F.count("z").alias("n_valid"), F.round(F.avg("z"), 6).alias("mean")).filter("n_valid > 0")


@query(with_views(", e AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM v_cells) SELECT i AS tr, j AS tc, round(i * h / ceil(h / 40), 6) AS r0, round(j * w / ceil(w / 40), 6) AS c0, round(h / ceil(h / 40), 6) AS height, round(w / ceil(w / 40), 6) AS width FROM e, unnest(range(0, CAST(ceil(h / 40) AS BIGINT))) AS a(i), unnest(range(0, CAST(ceil(w / 40) AS BIGINT))) AS b(j)", "v_cells"))
def s18_tile_grid(spark, sf_dir):
    """Equal tiles that cover a raster."""
    e = views.cells(spark, sf_dir).agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w")).withColumn("nr", F.ceil(F.col("h") / 40)).withColumn("nc", F.ceil(F.col("w") / 40))
    g = e.withColumn("tr", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1))).withColumn("tc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nc") - 1)))
    return g.select("tr", "tc", F.round(F.col("tr") * F.col("h") / F.col("nr"), 6).alias("r0"), F.round(F.col("tc") * F.col("w") / F.col("nc"), 6).alias("c0"), F.round(F.col("h") / F.col("nr"), 6).alias("height"), F.round(F.col("w") / F.col("nc"), 6).alias("width"))


@query(with_views(", t AS (SELECT r, c, z, CAST(floor(c / 30) AS BIGINT) AS tile FROM v_cells UNION ALL SELECT r, c, z + 1, CAST(floor(c / 30) AS BIGINT) + 1 FROM v_cells WHERE c % 30 >= 28) SELECT r, c, round(z, 6) AS z FROM (SELECT r, c, z, row_number() OVER (PARTITION BY r, c ORDER BY tile) AS k FROM t WHERE z IS NOT NULL) WHERE k = 1", "v_cells"))
def s20_mosaic(spark, sf_dir):
    """Overlapping tiles made one raster, the first tile's value where they overlap."""
    base = views.cells(spark, sf_dir).filter("z is not null").withColumn("tile", F.floor(F.col("c") / 30).cast("long"))
    over = base.filter("c % 30 >= 28").select("r", "c", (F.col("z") + 1).alias("z"), (F.col("tile") + 1).alias("tile"))
    return base.unionByName(over).groupBy("r", "c").agg(F.round(F.min_by("z", "tile"), 6).alias("z"))


_OFF = "SELECT i, j, sqrt(i * i + j * j) AS d FROM unnest(range(-{0}, {0} + 1)) AS a(i), unnest(range(-{0}, {0} + 1)) AS b(j) WHERE i * i + j * j <= {0} * {0}"


@query(with_views(f", o AS ({_OFF.format(2)}) SELECT p.r, p.c, round(avg(q.z), 9) AS focal_mean, round(stddev_pop(q.z), 9) AS focal_std, round(sum(q.z), 5) AS focal_sum, count(q.z) AS n FROM v_cells p CROSS JOIN o LEFT JOIN v_cells q ON q.r = p.r + i AND q.c = p.c + j GROUP BY p.r, p.c", "v_cells"))
def w06_focal(spark, sf_dir):
    """Mean, deviation and sum over a disc of radius 2."""
    f = raster.focal(views.cells(spark, sf_dir), raster.disc(2))
    return f.select("r", "c", F.round("focal_mean", 9).alias("focal_mean"), F.round("focal_std", 9).alias("focal_std"), F.round("focal_sum", 5).alias("focal_sum"), F.col("focal_n").alias("n"))


@query(with_views(f", o AS ({_OFF.format(4)}) SELECT p.r, p.c, round(avg(q.z), 11) AS focal_mean, round(stddev_pop(q.z), 11) AS focal_std, count(q.z) AS n FROM v_cells p CROSS JOIN o LEFT JOIN v_cells q ON q.r = p.r + i AND q.c = p.c + j GROUP BY p.r, p.c", "v_cells"))
def w06_focal_tiled(spark, sf_dir):
    """Mean and deviation over a disc of radius 4, by tiles with a halo."""
    f = raster.focal_tiled(views.cells(spark, sf_dir), raster.disc(4), tile=64)
    return f.select("r", "c", F.round("focal_mean", 11).alias("focal_mean"), F.round("focal_std", 11).alias("focal_std"), F.col("focal_n").alias("n"))


_COST = f""", k AS (SELECT r, c, CAST(z > 10 AS INTEGER) AS k FROM v_cells WHERE z IS NOT NULL), o AS ({_OFF.format(2)}),
f AS (SELECT p.r, p.c, p.k, avg(q.k) AS m, stddev_pop(q.k) AS s FROM k p CROSS JOIN o JOIN k q ON q.r = p.r + i AND q.c = p.c + j GROUP BY p.r, p.c, p.k),
e AS (SELECT p.r, p.c, greatest(0, 2 - min(d)) / 2 AS sm FROM k p CROSS JOIN o JOIN k q ON q.r = p.r + i AND q.c = p.c + j WHERE q.k = 1 GROUP BY p.r, p.c)"""


@query(with_views(_COST + " SELECT f.r, f.c, f.k AS canopy, round(power(exp(CASE WHEN f.k = 1 THEN 1 ELSE CASE WHEN m + s > 0 THEN (1 + (m - s) / (m + s)) / 2 ELSE 0 END * 0.7 + coalesce(sm, 0) * 0.3 END), 1.5), 6) AS cost FROM f LEFT JOIN e USING (r, c)", "v_cells"))
def t01_canopy_cost(spark, sf_dir):
    """Canopy and cost rasters: canopy over 10, radius 2, reach 2, avoidance 0.3, exponent 1.5."""
    out = raster.cost(views.cells(spark, sf_dir), threshold=10.0, radius=2.0, reach=2.0, avoidance=0.3, exponent=1.5)
    return out.select("r", "c", "canopy", F.round("cost", 6).alias("cost"))


@query()
def t01_documented_canopy_cost(spark, sf_dir):
    """The same with the documented values: canopy over 1, radius 3, reach 10, avoidance 0.3, exponent 1.5."""
    return _cost(spark, sf_dir).select("r", "c", "canopy", F.round("cost", 6).alias("cost"))


def _cost(spark, sf_dir):
    return raster.cost(views.cells(spark, sf_dir), threshold=1.0, radius=3.0, reach=10.0, avoidance=0.3, exponent=1.5)


@query(with_views(", g AS (SELECT p.r, p.c, max(q.z) AS z FROM v_cells p JOIN v_cells q ON abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1 AND q.r BETWEEN p.r - 1 AND p.r + 1 WHERE p.z IS NOT NULL GROUP BY p.r, p.c) SELECT p.r, p.c, round(min(q.z), 6) AS z FROM g p JOIN g q ON q.r BETWEEN p.r - 1 AND p.r + 1 AND q.c BETWEEN p.c - 1 AND p.c + 1 GROUP BY p.r, p.c", "v_cells"))
def r07_closing(spark, sf_dir):
    """Grey dilation, then erosion, over 3 by 3 cells."""
    return raster.closed(views.cells(spark, sf_dir), 1).select("r", "c", F.round("z", 6).alias("z"))


@query(with_views("SELECT DISTINCT CAST(floor(y) AS BIGINT) AS r, CAST(floor(x) AS BIGINT) AS c FROM v_points", "v_points"))
def r09_rasterized_points(spark, sf_dir):
    """Cells that hold a point."""
    return views.points(spark, sf_dir).select(F.floor("y").cast("long").alias("r"), F.floor("x").cast("long").alias("c")).distinct()


@query(with_views("SELECT CAST(least(greatest(floor(z), 0), 99) AS BIGINT) AS bin, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY least(greatest(floor(z), 0), 99)) AS BIGINT) AS below, sum(count(*)) OVER (ORDER BY least(greatest(floor(z), 0), 99)) * 2 >= sum(count(*)) OVER () AS past_half FROM v_cells WHERE z IS NOT NULL GROUP BY 1, least(greatest(floor(z), 0), 99)", "v_cells"))
def a17_half_count(spark, sf_dir):
    """A histogram of 100 unit bins and the bin where half of the cells are reached."""
    from pyspark.sql import Window

    h = views.cells(spark, sf_dir).filter("z is not null").groupBy(F.least(F.greatest(F.floor("z"), F.lit(0)), F.lit(99)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.orderBy("bin")
    return h.select("bin", "n", F.sum("n").over(w).alias("below"), (F.sum("n").over(w) * 2 >= F.sum("n").over(Window.partitionBy())).alias("past_half"))


@query(with_views(f", o AS ({_OFF.format(2)}), f AS (SELECT p.r, p.c, p.z, avg(q.z) AS m FROM v_cells p CROSS JOIN o LEFT JOIN v_cells q ON q.r = p.r + i AND q.c = p.c + j GROUP BY p.r, p.c, p.z), g AS (SELECT max(m) - min(m) AS span FROM f) SELECT r, c, round(m - z, 9) AS chh, CASE WHEN m - z < -0.2 * span THEN -1 WHEN m - z > 0.2 * span THEN 1 ELSE 0 END AS class FROM f, g WHERE z IS NOT NULL", "v_cells"))
def r12_hummock_hollow(spark, sf_dir):
    """Depth of each cell below its surroundings and its class (R12): hollows 1, hummocks -1."""
    f = raster.focal(views.cells(spark, sf_dir), raster.disc(2))
    span = f.agg((F.max("focal_mean") - F.min("focal_mean")).alias("span"))
    d = F.col("focal_mean") - F.col("z")
    cls = F.when(d < -0.2 * F.col("span"), -1).when(d > 0.2 * F.col("span"), 1).otherwise(0)
    return f.filter("z is not null").join(F.broadcast(span)).select("r", "c", F.round(d, 9).alias("chh"), cls.alias("class"))


@query(with_views("SELECT r, c, round(coalesce(z, -9999), 9) AS filled, round(CASE WHEN z IS NULL THEN 9999 WHEN z < 0 THEN 0 ELSE z END, 9) AS blocked, round(z - min(z) OVER (PARTITION BY r), 9) AS above_least, round(greatest(least(z / 20, 1), 0), 9) AS clamped FROM v_cells WHERE c BETWEEN 10 AND 89", "v_cells"))
def r05_nodata(spark, sf_dir):
    """Nodata filled and blocked, values less the row's least, clamped, cropped to a range of columns."""
    from pyspark.sql import Window

    z = F.col("z")
    out = views.cells(spark, sf_dir).filter("c between 10 and 89")
    return out.select("r", "c", F.round(F.coalesce(z, F.lit(-9999.0)), 9).alias("filled"), F.round(F.when(z.isNull(), 9999.0).when(z < 0, 0.0).otherwise(z), 9).alias("blocked"), F.round(z - F.min(z).over(Window.partitionBy("r")), 9).alias("above_least"), F.round(F.greatest(F.least(z / 20, F.lit(1.0)), F.lit(0.0)), 9).alias("clamped"))


_NINE = ", nine AS (SELECT p.r, p.c, p.z, {0} FROM v_cells p {1} WHERE p.z IS NOT NULL)"
_POS = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
_NINE = _NINE.format(", ".join(f"n{k}.z AS v{k}" for k in range(8)), " ".join(f"LEFT JOIN v_cells n{k} ON n{k}.r = p.r + {i} AND n{k}.c = p.c + {j}" for k, (i, j) in enumerate(_POS)))


def _heron() -> str:
    flat = [2, 1] * 4
    out = []
    for k in range(8):
        q = (k + 1) % 8
        a, b, c = f"sqrt(power(z - v{k}, 2) + {flat[k]})", f"sqrt(power(z - v{q}, 2) + {flat[q]})", f"sqrt(power(v{k} - v{q}, 2) + 1)"
        s = f"(({a} + {b} + {c}) / 2)"
        out.append(f"coalesce(sqrt(greatest({s} * ({s} - {a}) * ({s} - {b}) * ({s} - {c}), 0)), 0)")
    return " + ".join(out)


@query(with_views(_NINE + f" SELECT r, c, round({_heron()}, 5) AS surface, round(2 * ({_heron()}), 5) AS sar FROM nine", "v_cells"))
def w07_surface_area(spark, sf_dir):
    """Surface area and its ratio over 3 by 3 cells."""
    return raster.surface_area(views.cells(spark, sf_dir)).select("r", "c", F.round("surface", 5).alias("surface"), F.round("sar", 5).alias("sar"))


@query(with_views(_NINE + " SELECT r, c, round(sqrt(" + " + ".join(f"coalesce(power(v{k} - z, 2), 0)" for k in range(8)) + "), 6) AS tri FROM nine", "v_cells"))
def w07_ruggedness(spark, sf_dir):
    """Terrain ruggedness over 3 by 3 cells."""
    return raster.ruggedness(views.cells(spark, sf_dir)).select("r", "c", F.round("tri", 6).alias("tri"))


_GX, _GY = "((v2 + 2 * v3 + v4) - (v0 + 2 * v7 + v6))", "((v6 + 2 * v5 + v4) - (v0 + 2 * v1 + v2))"


@query(with_views(_NINE + f" SELECT r, c, round(degrees(atan(sqrt(power({_GX} / 8, 2) + power({_GY} / 8, 2)))), 6) AS slope, round(greatest({', '.join(f'v{k}' for k in range(8))}, z) - least({', '.join(f'v{k}' for k in range(8))}, z), 6) AS roughness, round(sqrt({_GX} * {_GX} + {_GY} * {_GY}), 5) AS edge FROM nine WHERE " + " AND ".join(f"v{k} IS NOT NULL" for k in range(8)), "v_cells"))
def w09_terrain(spark, sf_dir):
    """Slope, roughness and Sobel edges over 3 by 3 cells."""
    return raster.terrain(views.cells(spark, sf_dir)).select("r", "c", F.round("slope", 6).alias("slope"), F.round("roughness", 6).alias("roughness"), F.round("edge", 5).alias("edge"))


@query(
    with_views(
        _NINE
        + f""", sar AS (SELECT r, c, z, {_heron()} AS sa FROM nine),
side AS (SELECT id, CASE WHEN c + 0.5 < x0 + (x1 - x0) / 3 THEN 'L' WHEN c + 0.5 < x0 + 2 * (x1 - x0) / 3 THEN 'C' ELSE 'R' END AS side, z, sa FROM v_boxes JOIN sar ON {_IN})
SELECT id, side, count(*) AS pl_area, round(avg(z), 6) AS mean, round(stddev_pop(z), 5) AS std_dev, round(max(z), 6) AS max, round(min(z), 6) AS min, round(sum(sa), 4) AS sur_area, round(avg(2 * sa), 5) AS sar_mean, round(stddev_pop(2 * sa), 4) AS sar_std, round(max(2 * sa), 5) AS sar_max, round(min(2 * sa), 5) AS sar_min FROM side GROUP BY id, side""",
        "v_cells",
        "v_boxes",
    )
)
def t15_line_metrics(spark, sf_dir):
    """Height and surface metrics of each footprint's left, centre and right thirds."""
    sar = raster.surface_area(views.cells(spark, sf_dir)).withColumn("px", F.col("c") + 0.5).withColumn("py", F.col("r") + 0.5)
    third = (F.col("x1") - F.col("x0")) / 3
    side = F.when(F.col("px") < F.col("x0") + third, "L").when(F.col("px") < F.col("x0") + 2 * third, "C").otherwise("R")
    rows = points_in_boxes(sar, views.boxes(spark, sf_dir), "px", "py").withColumn("side", side)
    a = lambda f, c, n, k: F.round(f(c), k).alias(n)
    return rows.groupBy("id", "side").agg(
        F.count("*").alias("pl_area"), a(F.avg, "z", "mean", 6), a(F.stddev_pop, "z", "std_dev", 5), a(F.max, "z", "max", 6), a(F.min, "z", "min", 6), a(F.sum, "surface", "sur_area", 4),
        a(F.avg, "sar", "sar_mean", 5), a(F.stddev_pop, "sar", "sar_std", 4), a(F.max, "sar", "sar_max", 5), a(F.min, "sar", "sar_min", 5),
    )


_RING = """, seg AS (SELECT line_id, seq, x1, y1, x2, y2 FROM v_segs WHERE x2 IS NOT NULL),
m AS (SELECT line_id, seq, r, c, z, x1, y1, x2, y2, c + 0.5 AS px, r + 0.5 AS py, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE least(greatest(((c + 0.5 - x1) * (x2 - x1) + (r + 0.5 - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)), 0), 1) END AS t
  FROM seg JOIN v_cells ON c + 0.5 BETWEEN least(x1, x2) - 4 AND greatest(x1, x2) + 4 AND r + 0.5 BETWEEN least(y1, y2) - 4 AND greatest(y1, y2) + 4 WHERE z IS NOT NULL),
d AS (SELECT *, sqrt(power(px - x1 - t * (x2 - x1), 2) + power(py - y1 - t * (y2 - y1), 2)) AS d, sign((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) AS side FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY line_id, r, c ORDER BY round(d, 9), seq) AS k FROM d WHERE d < 4),
med AS (SELECT line_id, side, floor(d) AS ring, quantile_cont(z, 0.5) AS median FROM b WHERE k = 1 AND side <> 0 GROUP BY 1, 2, 3)"""


def _medians(spark, sf_dir, n):
    return linear.line_ring_medians(views.cells(spark, sf_dir), linear.segments(views.vertices(spark, sf_dir)), n=n)


@query(with_views(_RING + " SELECT line_id, CAST(side AS INTEGER) AS side, CAST(ring AS INTEGER) AS ring, round(median, 6) AS median FROM med", "v_cells", "v_vertices", "v_segs"))
def a05_ring_medians(spark, sf_dir):
    """Median height in four one-sided rings of width 1 about each line."""
    return _medians(spark, sf_dir, 4).withColumn("median", F.round("median", 6))


@query()
def a05_fifteen_ring_medians(spark, sf_dir):
    """Median height in all fifteen one-sided rings of width 1 about each line."""
    return _medians(spark, sf_dir, 15).withColumn("median", F.round("median", 6))


@query(
    with_views(
        _RING
        + """, ch AS (SELECT *, CASE WHEN ring = 0 THEN 0 WHEN lag(ring) OVER w = ring - 1 THEN median - lag(median) OVER w END AS rise FROM med WINDOW w AS (PARTITION BY line_id, side ORDER BY ring)),
hits AS (SELECT line_id, side, ring, median, CASE WHEN rise >= 1.5 - 1e-9 THEN 0 WHEN rise >= 1.4 - 1e-9 THEN 1 WHEN rise >= 1.3 - 1e-9 THEN 2 WHEN rise >= 1.2 - 1e-9 THEN 3 END AS level FROM ch WHERE median >= 0.5 AND ring < 3),
first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id, side ORDER BY level, ring) AS k FROM hits WHERE level IS NOT NULL) WHERE k = 1),
s AS (SELECT med.line_id, med.side, quantile_cont(med.median, 0.5) AS m, any_value(f.ring) AS ring, any_value(f.median) AS fm FROM med LEFT JOIN first_ f ON f.line_id = med.line_id AND f.side = med.side GROUP BY 1, 2),
cut AS (SELECT line_id, side, CASE WHEN fm IS NOT NULL THEN ring + 1 WHEN m <= 0.5 THEN 4 WHEN m <= 5 THEN 4.5 WHEN m <= 10 THEN 5.5 WHEN m <= 15 THEN 6 ELSE 5 END AS dist,
  CASE WHEN fm IS NOT NULL THEN CASE WHEN floor(fm) <= 0.5 AND ring + 1 > 5 THEN 2 WHEN floor(fm) > 15 AND ring + 1 > 4 THEN 15.5 ELSE floor(fm) END WHEN m <= 0.5 THEN 0.5 WHEN m <= 15 THEN floor(m) ELSE 15.5 END AS ht, CASE WHEN m > 1 THEN 0.3 * m ELSE 1 END AS th FROM s)
SELECT line_id, round(max(ht) FILTER (WHERE side = 1), 6) AS "CL_CutHt", round(max(ht) FILTER (WHERE side = -1), 6) AS "CR_CutHt", round(max(dist) FILTER (WHERE side = 1), 6) AS "LDist_Cut", round(max(dist) FILTER (WHERE side = -1), 6) AS "RDist_Cut", round(avg(th), 6) AS "DynCanTh" FROM cut GROUP BY line_id""",
        "v_cells",
        "v_vertices",
        "v_segs",
    )
)
def t06_relative_threshold(spark, sf_dir):
    """Where each side's ring medians first jump, and the canopy threshold that they give."""
    return _thresholds(spark, sf_dir, 4)


@query()
def t06_fifteen_ring_threshold(spark, sf_dir):
    """The same over all fifteen rings of the reference."""
    return _thresholds(spark, sf_dir, 15)


def _thresholds(spark, sf_dir, n):
    out = linear.relative_thresholds(views.cells(spark, sf_dir), linear.segments(views.vertices(spark, sf_dir)), n=n)
    return out.select("line_id", *(F.round(c, 6).alias(c) for c in ("CL_CutHt", "CR_CutHt", "LDist_Cut", "RDist_Cut", "DynCanTh")))


def _lines_between_ends(spark, sf_dir):
    s = views.vertices(spark, sf_dir).groupBy("line_id").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"), F.count("*").alias("n"))
    return s.filter("n > 1").select("line_id", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


@query()
def d01_least_cost_paths(spark, sf_dir):
    """Least-cost path between each line's ends over the canopy cost."""
    return paths.least_cost_paths(_cost(spark, sf_dir), _lines_between_ends(spark, sf_dir), 2.0).select("line_id", "n_cells", F.round("path_cost", 5).alias("path_cost"))


@query()
def t02_corridor_footprints(spark, sf_dir):
    """Corridor, its regions and outlines, and a central line of each line (R06, R08, D04, D09, D10, G11; T02, T09)."""
    out = paths.footprints(_cost(spark, sf_dir), _lines_between_ends(spark, sf_dir), 2.0, 3.0)
    return out.select("line_id", "status", "n_regions", "area", "largest", "n_rings", F.size("centre").alias("n_centre"), "centre", "rings")

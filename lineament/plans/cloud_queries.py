"""Queries over LiDAR returns and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineament.operators import lidar, raster
from lineament.plans.registry import query
from lineament.sources import views
from lineament.sources.views import with_views

_PIX = "CAST(floor(x / 5) AS BIGINT) AS px, CAST(floor(y / 5) AS BIGINT) AS py"


@query(with_views("SELECT cls, count(*) AS n, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, round(avg(intensity), 4) AS intensity FROM v_las WHERE cls <> 7 AND z >= 0 AND z <= 25 GROUP BY cls", "v_las"))
def s08_las_filter(spark, sf_dir):
    """Returns read without a class and above a height, by class."""
    return lidar.las_filter(views.las(spark, sf_dir), 7, 0.0, 25.0).groupBy("cls").agg(F.count("*").alias("n"), F.round(F.min("z"), 6).alias("z_min"), F.round(F.max("z"), 6).alias("z_max"), F.round(F.avg("intensity"), 4).alias("intensity"))


@query(with_views("SELECT px, py, round(max(z), 6) AS zmax, round(min(z), 6) AS zmin, round(stddev_samp(z), 6) AS zsd, " + ", ".join(f"round(quantile_cont(z, {q / 100}), 6) AS zq{q}" for q in lidar.LEVELS) + f" FROM (SELECT {_PIX}, z FROM v_las) GROUP BY px, py", "v_las"))
def a10_height_metrics(spark, sf_dir):
    """Height metrics of each pixel."""
    m = lidar.height_metrics(views.las(spark, sf_dir), 5.0)
    return m.select("px", "py", *(F.round(c, 6).alias(c) for c in m.columns[2:]))


@query(with_views(f"SELECT px, py, count(*) AS total, count(*) FILTER (WHERE z BETWEEN 2 AND 20) AS hits, round(count(*) FILTER (WHERE z BETWEEN 2 AND 20) / count(*), 6) AS cover FROM (SELECT {_PIX}, z FROM v_las) GROUP BY px, py", "v_las"))
def a11_vegetation_cover(spark, sf_dir):
    """Share of each pixel's returns between two heights."""
    return lidar.share(views.las(spark, sf_dir), 5.0, F.col("z").between(2, 20), "cover").withColumn("cover", F.round("cover", 6))


@query(with_views(f"SELECT px, py, round(count(*) FILTER (WHERE z >= 1.3) / count(*), 6) AS above_dbh FROM (SELECT {_PIX}, z FROM v_las WHERE cls <> 7) GROUP BY px, py", "v_las"))
def a12_above_dbh(spark, sf_dir):
    """Share of each pixel's returns at breast height or over."""
    return lidar.share(lidar.las_filter(views.las(spark, sf_dir), 7, None), 5.0, F.col("z") >= 1.3, "above_dbh").select("px", "py", F.round("above_dbh", 6).alias("above_dbh"))


@query(with_views("SELECT count(*) AS n, round(max(x) - min(x), 6) AS width, round(max(y) - min(y), 6) AS height, round(count(*) / ((max(x) - min(x)) * (max(y) - min(y))), 6) AS density, round(0.05 * round(sqrt(3 / (count(*) / ((max(x) - min(x)) * (max(y) - min(y))))) / 0.05), 2) AS cell FROM v_las", "v_las"))
def a16_catalog_info(spark, sf_dir):
    """Extent, area and density of the returns, and the cell size that they recommend."""
    w, h = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    d = F.count("*") / (w * h)
    return views.las(spark, sf_dir).agg(F.count("*").alias("n"), F.round(w, 6).alias("width"), F.round(h, 6).alias("height"), F.round(d, 6).alias("density"), lidar.cell_size(d).alias("cell"))


@query(with_views("SELECT round(quantile_cont(z, 0.05), 6) AS q05, round(quantile_cont(z, 0.02), 6) AS q02, round(max(z) - min(z), 6) AS span FROM v_cells", "v_cells"))
def a14_raster_quantiles(spark, sf_dir):
    """Global low quantiles and range of a raster."""
    return views.cells(spark, sf_dir).agg(F.round(F.percentile("z", F.lit(0.05)), 6).alias("q05"), F.round(F.percentile("z", F.lit(0.02)), 6).alias("q02"), F.round(F.max("z") - F.min("z"), 6).alias("span"))


@query(with_views(f", t AS (SELECT px, py, count(*) / 25 AS d FROM (SELECT {_PIX} FROM v_las WHERE cls <> 7) GROUP BY px, py), g AS (SELECT px, py, count(*) / 25 AS d FROM (SELECT {_PIX} FROM v_las WHERE cls = 2) GROUP BY px, py) SELECT t.px, t.py, round(g.d / t.d, 6) AS lpi, round(-cos(radians(15)) / 0.5 * ln(g.d / t.d), 6) AS elai FROM t LEFT JOIN g USING (px, py)", "v_las"))
def r11_gap_fraction(spark, sf_dir):
    """Light penetration and effective leaf area from return densities."""
    points = views.las(spark, sf_dir)
    out = lidar.gap_fraction(lidar.density(lidar.las_filter(points, 7, None), 5.0), lidar.density(points.filter("cls = 2"), 5.0), 30.0)
    return out.select("px", "py", F.round("lpi", 6).alias("lpi"), F.round("elai", 6).alias("elai"))


@query(with_views(f", p AS (SELECT {_PIX}, count(*) / 25 AS d FROM v_las GROUP BY 1, 2) SELECT a.px, a.py, round(sum(b.d), 6) AS focal FROM p a JOIN p b ON (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= 4 GROUP BY a.px, a.py", "v_las"))
def l06_density_focal(spark, sf_dir):
    """Return densities summed over a disc of two pixels."""
    d = lidar.density(views.las(spark, sf_dir), 5.0).select(F.col("py").alias("r"), F.col("px").alias("c"), F.col("density").alias("z"))
    return raster.focal(d, raster.disc(2)).select(F.col("c").alias("px"), F.col("r").alias("py"), F.round("focal_sum", 6).alias("focal"))


@query(with_views(", g AS (SELECT x, y, z FROM v_las WHERE cls = 2), d AS (SELECT id, sqrt(power(p.x - g.x, 2) + power(p.y - g.y, 2)) AS d, z, g.x, g.y FROM v_points p JOIN g ON abs(p.x - g.x) <= 5 AND abs(p.y - g.y) <= 5), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, z, x, y) AS k FROM d WHERE d <= 5), w AS (SELECT id, sum(z / power(greatest(d, 1e-6), 2)) / sum(1 / power(greatest(d, 1e-6), 2)) AS ground FROM k WHERE k <= 3 GROUP BY id) SELECT p.id, round(w.ground, 5) AS ground, round(p.h - w.ground, 5) AS above FROM v_points p LEFT JOIN w USING (id)", "v_points", "v_las"))
def l01_height_above_ground(spark, sf_dir):
    """Heights over the inverse-distance mean of the three nearest ground returns (L01 and L02 by nearest neighbours)."""
    out = lidar.ground_height(views.las(spark, sf_dir), views.points(spark, sf_dir), 3, 5.0)
    return out.select("id", F.round("ground", 5).alias("ground"), F.round(F.col("h") - F.col("ground"), 5).alias("above"))


@query(with_views(f"SELECT px, py, round(max(z), 6) AS top FROM (SELECT {_PIX}, z FROM v_las WHERE cls <> 7 AND z >= 0) GROUP BY px, py", "v_las"))
def l03_highest_return(spark, sf_dir):
    """Highest return of each pixel: a surface model without triangulation (substitute for L03)."""
    return lidar.pixel(lidar.las_filter(views.las(spark, sf_dir)), 5.0).groupBy("px", "py").agg(F.round(F.max("z"), 6).alias("top"))


@query(with_views("SELECT p.r, p.c, round(p.z, 6) AS z FROM v_cells p WHERE p.z > 5 AND NOT EXISTS (SELECT 1 FROM v_cells q WHERE q.r BETWEEN p.r - 5 AND p.r + 5 AND q.c BETWEEN p.c - 5 AND p.c + 5 AND sqrt(power(q.r - p.r, 2) + power(q.c - p.c, 2)) <= (0.3 * p.z + 1.5) / 2 AND (q.z > p.z OR (q.z = p.z AND (q.r < p.r OR (q.r = p.r AND q.c < p.c)))))", "v_cells"))
def l04_tree_tops(spark, sf_dir):
    """Local maxima of the canopy under a window that grows with height."""
    return lidar.tree_tops(views.cells(spark, sf_dir), 0.3 * F.col("z") + 1.5, 5.0, 5).select("r", "c", F.round("z", 6).alias("z"))


@query(with_views("SELECT p.id, round(p.x, 6) AS x, round(p.y, 6) AS y, round(p.h, 6) AS h FROM v_points p WHERE p.h > 2 AND NOT EXISTS (SELECT 1 FROM v_points q WHERE sqrt(power(q.x - p.x, 2) + power(q.y - p.y, 2)) <= 0.478676 * power(p.h, 0.695289) / 2 AND (q.h > p.h OR (q.h = p.h AND q.id < p.id)))", "v_points"))
def l05_point_tops(spark, sf_dir):
    """Local maxima of points under a window of their height."""
    h = views.points(spark, sf_dir)
    tops = lidar.point_tops(h, 0.478676 * F.pow(F.greatest("h", F.lit(0.0)), F.lit(0.695289)), 2.0, 4.0)
    return tops.select("id", *(F.round(c, 6).alias(c) for c in ("x", "y", "h")))


@query()
def r13_conductivity(spark, sf_dir):
    """Conductivity and its cost from terrain, canopy, intensity, ground and low vegetation."""
    points = views.las(spark, sf_dir)
    ground = lidar.pixel(points.filter("cls = 2"), 5.0).groupBy("px", "py").agg(F.avg("z").alias("z"))
    terrain = raster.terrain(ground.select(F.col("py").alias("r"), F.col("px").alias("c"), "z")).select(F.col("c").alias("px"), F.col("r").alias("py"), "slope", "roughness", "edge")
    by = lambda df, *a: lidar.pixel(df, 5.0).groupBy("px", "py").agg(*a)
    low = points.filter("z between 1 and 3 and cls not in (2, 6, 9)")
    out = lidar.conductivity(terrain, by(points, F.max("z").alias("chm")), by(points, (F.max("intensity") - F.min("intensity")).alias("irange")), by(points.filter("cls = 2"), (F.count("*") / 25).alias("gpd")), by(low, (F.count("*") / 25).alias("lower")))
    return out.select("px", "py", F.round("conduct", 6).alias("conduct"), F.round("cost", 6).alias("cost"))

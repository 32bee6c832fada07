"""Queries over tables as such: sources, sinks, projections, sets and order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lineament.plans.registry import query
from lineament.plans.storage import new_path
from lineament.sources import layers, views
from lineament.sources.views import with_views


@query(with_views("SELECT line_id, count(*) AS n_vertices, round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(min(y), 6) AS y0, round(max(y), 6) AS y1 FROM v_vertices GROUP BY line_id", "v_vertices"))
def s01_vector_scan(spark, sf_dir):
    """Whole-layer read with each line's bounds."""
    return views.vertices(spark, sf_dir).groupBy("line_id").agg(F.count("*").alias("n_vertices"), F.round(F.min("x"), 6).alias("x0"), F.round(F.max("x"), 6).alias("x1"), F.round(F.min("y"), 6).alias("y0"), F.round(F.max("y"), 6).alias("y1"))


@query(with_views("SELECT line_id, part, count(*) AS n FROM (SELECT line_id, seq % 2 AS part FROM v_vertices WHERE x > 5) GROUP BY line_id, part", "v_vertices"))
def s02_multipart_explode(spark, sf_dir):
    """Multipart features exploded into parts, null geometries skipped."""
    v = views.vertices(spark, sf_dir).withColumn("p", F.when(F.col("x") > 5, F.struct("x", "y"))).withColumn("part", F.col("seq") % 2)
    parts = v.groupBy("line_id", "part").agg(F.collect_list("p").alias("pts")).groupBy("line_id").agg(F.collect_list(F.struct("part", "pts")).alias("parts"))
    return parts.select("line_id", F.explode("parts").alias("p")).select("line_id", F.col("p.part").alias("part"), F.size("p.pts").cast("long").alias("n")).filter("n > 0")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1")
def s04_first_row(spark, sf_dir):
    """The first row: the one place where the limit is the feature."""
    return views.stored(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(1)


@query("SELECT CAST(s_suppkey AS BIGINT) AS task, concat('lines_', lpad(CAST(s_suppkey AS VARCHAR), 5, '0')) AS in_line, concat('chm_', CAST(s_nationkey AS VARCHAR)) AS in_chm FROM supplier")
def s10_task_csv(spark, sf_dir):
    """A batch's task list written and read as CSV."""
    tasks = views.stored(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task"), F.concat(F.lit("lines_"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("in_line"), F.concat(F.lit("chm_"), F.col("s_nationkey").cast("string")).alias("in_chm"))
    path = new_path(spark, "tasks")
    layers.write_task_csv(tasks, path)
    return layers.read_task_csv(spark, path, "task long, in_line string, in_chm string")


@query("SELECT CAST(s_nationkey AS BIGINT) AS tile, 'centerline' AS tool_api, CAST(s_suppkey AS BIGINT) AS task, s_name AS in_line FROM supplier")
def s11_project_json(spark, sf_dir):
    """A project of task groups written and read as JSON, its tasks exploded."""
    tasks = views.stored(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("tile"), F.col("s_suppkey").alias("task"), F.col("s_name").alias("in_line"))
    path = new_path(spark, "project")
    layers.write_project(tasks, "centerline", path)
    return layers.read_project(spark, path, "tile long, tool_api string, tasks array<struct<task: long, in_line: string>>")


@query(with_views("SELECT id, x0, y0 FROM v_boxes", "v_boxes"))
def s14_layer_write(spark, sf_dir):
    """Several layers written to one place and one read back."""
    path = new_path(spark, "layers")
    b = views.boxes(spark, sf_dir)
    layers.write_layers({"polygons": b.select("id", "x0", "y0"), "points": views.points(spark, sf_dir).select("id", "h")}, path)
    return layers.read_layer(spark, path, "polygons").select("id", "x0", "y0")


@query(with_views("SELECT cls, count(*) AS n, round(sum(z), 4) AS z FROM v_las GROUP BY cls", "v_las"))
def s22_format_rewrite(spark, sf_dir):
    """A point cloud rewritten in another columnar format and read back."""
    path = new_path(spark, "cloud")
    views.las(spark, sf_dir).write.orc(path)
    return spark.read.orc(path).groupBy("cls").agg(F.count("*").alias("n"), F.round(F.sum("z"), 4).alias("z"))


@query("SELECT o_orderkey AS olnfid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS olnseg, coalesce(nullif(o_orderstatus, 'P'), 'none') AS status FROM orders")
def p02_default_keys(spark, sf_dir):
    """Key and default columns put in."""
    seg = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return views.stored(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("olnfid"), seg.cast("long").alias("olnseg"), F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("none")).alias("status"))


@query(with_views("SELECT r, c, round(z, 6) AS z FROM v_cells WHERE z IS NOT NULL", "v_cells"))
def p06_drop_null(spark, sf_dir):
    """Rows with a null in a subset of columns dropped."""
    return views.cells(spark, sf_dir).na.drop(subset=["z"]).select("r", "c", F.round("z", 6).alias("z"))


@query(with_views("SELECT r, c, round(coalesce(z - lag(z) OVER w, 0), 6) AS change, round(avg(z) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS mid FROM v_cells WHERE z IS NOT NULL WINDOW w AS (PARTITION BY r ORDER BY c)", "v_cells"))
def w02_differences(spark, sf_dir):
    """First differences with a leading 0 and rolling means of two."""
    w = Window.partitionBy("r").orderBy("c")
    z = views.cells(spark, sf_dir).filter("z is not null")
    return z.select("r", "c", F.round(F.coalesce(F.col("z") - F.lag("z").over(w), F.lit(0.0)), 6).alias("change"), F.round(F.avg("z").over(w.rowsBetween(-1, 0)), 6).alias("mid"))


@query(with_views("SELECT id, ecosite, CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS area FROM (SELECT *, row_number() OVER (PARTITION BY ecosite ORDER BY (x1 - x0) * (y1 - y0) DESC, id) AS k FROM v_boxes) WHERE k = 1", "v_boxes"))
def o03_largest_part(spark, sf_dir):
    """The largest polygon of each ecosite."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    best = views.boxes(spark, sf_dir).groupBy("ecosite").agg(F.max_by(F.struct("id", area.cast("long").alias("area")), F.struct(area, -F.col("id"))).alias("b"))
    return best.select(F.col("b.id").alias("id"), "ecosite", F.col("b.area").alias("area"))


@query(with_views("SELECT ecosite, min_by(x0, id) AS x0, count(*) AS n_parts, CAST(min(y0) AS BIGINT) AS y0, CAST(max(y1) AS BIGINT) AS y1 FROM v_boxes GROUP BY ecosite", "v_boxes"))
def a01_dissolve(spark, sf_dir):
    """Polygons dissolved by ecosite: the first part's attributes and the bounds of all."""
    return views.boxes(spark, sf_dir).groupBy("ecosite").agg(F.min_by("x0", "id").alias("x0"), F.count("*").alias("n_parts"), F.min("y0").cast("long").alias("y0"), F.max("y1").cast("long").alias("y1"))


@query(with_views("SELECT id, 'box' AS kind, ecosite FROM v_boxes UNION ALL SELECT id, 'tree', NULL FROM v_points", "v_boxes", "v_points"))
def u01_union(spark, sf_dir):
    """Layers of different columns put one after another."""
    return views.boxes(spark, sf_dir).select("id", F.lit("box").alias("kind"), "ecosite").unionByName(views.points(spark, sf_dir).select("id", F.lit("tree").alias("kind")), allowMissingColumns=True)


@query(with_views("SELECT CAST(floor(c / 2) AS BIGINT) AS tc, CAST(floor(r / 2) AS BIGINT) AS tr, count(DISTINCT id) AS n FROM v_boxes JOIN v_cells ON c + 0.5 >= x0 AND c + 0.5 < x1 AND r + 0.5 >= y0 AND r + 0.5 < y1 GROUP BY 1, 2", "v_boxes", "v_cells"))
def u03_cell_union(spark, sf_dir):
    """Polygons' union as cells, with how many lie over each block of cells."""
    from lineament.operators.spatial_join import points_in_boxes

    spots = views.cells(spark, sf_dir).select("r", "c", (F.col("c") + 0.5).alias("px"), (F.col("r") + 0.5).alias("py"))
    met = points_in_boxes(spots, views.boxes(spark, sf_dir), "px", "py")
    return met.groupBy(F.floor(F.col("c") / 2).cast("long").alias("tc"), F.floor(F.col("r") / 2).cast("long").alias("tr")).agg(F.countDistinct("id").alias("n"))

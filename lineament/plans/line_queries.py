"""Queries over polylines and their networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineament.functions import geo
from lineament.operators import linear, network
from lineament.plans.registry import query
from lineament.sources import views
from lineament.sources.views import with_views

_SEG = ("v_vertices", "v_segs")
_LEN = "sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))"


@query(
    with_views(
        f""", n AS (SELECT line_id, min(seq) AS a, max(seq) AS b FROM v_vertices GROUP BY line_id),
e AS (SELECT n.line_id, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM n JOIN v_vertices p ON p.line_id = n.line_id AND p.seq = a JOIN v_vertices q ON q.line_id = n.line_id AND q.seq = b),
l AS (SELECT line_id, coalesce(sum({_LEN}), 0) AS len FROM v_segs GROUP BY line_id),
b AS (SELECT line_id, len, {_LEN} AS euc, CASE WHEN x1 = x2 AND y1 = y2 THEN NULL ELSE (degrees(atan2(x2 - x1, y2 - y1)) + 360) % 360 END AS deg FROM e JOIN l USING (line_id))
SELECT line_id, round(len, 6) AS length, round(CASE WHEN euc > 0 THEN len / euc END, 6) AS sinuosity, round(deg, 6) AS bearing,
CASE WHEN (deg >= 22.5 AND deg < 67.5) OR (deg >= 202.5 AND deg < 247.5) THEN 'NE-SW' WHEN (deg >= 67.5 AND deg < 112.5) OR (deg >= 247.5 AND deg < 292.5) THEN 'E-W'
WHEN (deg >= 112.5 AND deg < 157.5) OR (deg >= 292.5 AND deg < 337.5) THEN 'NW-SE' ELSE 'N-S' END AS direction FROM b""".lstrip(),
        *_SEG,
    )
)
def t12_line_attributes(spark, sf_dir):
    """Length, sinuosity, bearing and direction class of each line (G01, G03, G04, G06, G07; T12 without rasters)."""
    a, b = F.element_at("pts", 1), F.element_at("pts", -1)
    deg = geo.bearing(a["x"], a["y"], b["x"], b["y"])
    lines = geo.lines(views.vertices(spark, sf_dir)).withColumn("deg", deg)
    return lines.select("line_id", F.round(geo.length(F.col("pts")), 6).alias("length"), F.round(geo.sinuosity(F.col("pts")), 6).alias("sinuosity"), F.round("deg", 6).alias("bearing"), geo.direction(F.col("deg")).alias("direction"))


@query(
    with_views(
        f""", r AS (SELECT line_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM v_vertices WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
s AS (SELECT line_id, count(*) AS n, abs(sum(x * ny - nx * y)) / 2 AS area, sum(sqrt(power(nx - x, 2) + power(ny - y, 2))) AS per FROM r GROUP BY line_id)
SELECT line_id, round(area, 5) AS area, round(per, 6) AS perimeter, round(CASE WHEN area > 1e-6 THEN per / area END, 3) AS fragment FROM s WHERE n >= 3""".lstrip(),
        "v_vertices",
    )
)
def g02_ring_area(spark, sf_dir):
    """Area, perimeter and fragmentation of lines closed to rings."""
    rings = geo.lines(views.vertices(spark, sf_dir)).filter(F.size("pts") >= 3).select("line_id", geo.ring_area(F.col("pts")).alias("a"), geo.ring_perimeter(F.col("pts")).alias("p"))
    return rings.select("line_id", F.round("a", 5).alias("area"), F.round("p", 6).alias("perimeter"), F.round(F.when(F.col("a") > 1e-6, F.col("p") / F.col("a")), 3).alias("fragment"))


@query(with_views(f"SELECT line_id, seq AS seg, round({_LEN}, 6) AS seg_length, round(atan2(y2 - y1, x2 - x1), 6) AS angle FROM v_segs WHERE x2 IS NOT NULL AND {_LEN} > 0", *_SEG))
def w05_segments(spark, sf_dir):
    """Consecutive vertex pairs without zero lengths, with their angle."""
    s = linear.segments(views.vertices(spark, sf_dir))
    s = s.withColumn("d", F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)).filter("d > 0")
    return s.select("line_id", "seg", F.round("d", 6).alias("seg_length"), F.round(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")), 6).alias("angle"))


_TRI = """, tri AS (SELECT * FROM (SELECT line_id, seq, lag(x) OVER w AS x0, lag(y) OVER w AS y0, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v_vertices WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE x0 IS NOT NULL AND x2 IS NOT NULL),
ang AS (SELECT line_id, seq, x, y, (atan2(y0 - y, x0 - x) + atan2(y2 - y, x2 - x)) / 2 AS a FROM tri),
tr AS (SELECT line_id, seq, x + 10 * cos(a) AS ax, y + 10 * sin(a) AS ay, x - 10 * cos(a) AS bx, y - 10 * sin(a) AS by_ FROM ang)"""
_WID = (
    _TRI
    + """, m AS (SELECT line_id, seq, ax, ay, bx, by_, x0, y0, x1, y1 FROM tr JOIN v_boxes ON least(ax, bx) <= x1 AND x0 <= greatest(ax, bx) AND least(ay, by_) <= y1 AND y0 <= greatest(ay, by_)),
t AS (SELECT line_id, seq, greatest(0.0, CASE WHEN bx = ax THEN 0 ELSE least((x0 - ax) / (bx - ax), (x1 - ax) / (bx - ax)) END, CASE WHEN by_ = ay THEN 0 ELSE least((y0 - ay) / (by_ - ay), (y1 - ay) / (by_ - ay)) END) AS t0,
  least(1.0, CASE WHEN bx = ax THEN 1 ELSE greatest((x0 - ax) / (bx - ax), (x1 - ax) / (bx - ax)) END, CASE WHEN by_ = ay THEN 1 ELSE greatest((y0 - ay) / (by_ - ay), (y1 - ay) / (by_ - ay)) END) AS t1 FROM m),
wd AS (SELECT tr.line_id, tr.seq, coalesce(max(greatest(t1 - t0, 0) * 20), 0) AS width FROM tr LEFT JOIN t ON tr.line_id = t.line_id AND tr.seq = t.seq GROUP BY 1, 2)"""
)


def _transects(spark, sf_dir):
    return linear.transects(linear.vertex_triples(views.vertices(spark, sf_dir)), 20.0)


def _widths(spark, sf_dir):
    return linear.transect_widths(_transects(spark, sf_dir), views.boxes(spark, sf_dir))


@query(with_views(_TRI + " SELECT line_id, seq, round(ax, 6) AS ax, round(ay, 6) AS ay, round(bx, 6) AS bx, round(by_, 6) AS by FROM tr", "v_vertices"))
def g23_transects(spark, sf_dir):
    """Perpendicular transects at interior vertices."""
    return _transects(spark, sf_dir).select("line_id", "seq", *(F.round(c, 6).alias(c) for c in ("ax", "ay", "bx", "by")))


@query(with_views(_WID + " SELECT line_id, seq, round(width, 5) AS width FROM wd", "v_vertices", "v_boxes"))
def j12_transect_widths(spark, sf_dir):
    """Longest part of each transect inside a polygon."""
    return _widths(spark, sf_dir).select("line_id", "seq", F.round("width", 5).alias("width"))


@query(
    with_views(
        _WID
        + " SELECT line_id, round(coalesce(quantile_cont(width, 0.4) FILTER (WHERE width > 1e-6), 5.0), 5) AS avg_width, round(coalesce(quantile_cont(width, 0.9) FILTER (WHERE width > 1e-6), 5.0), 5) AS max_width FROM wd GROUP BY line_id",
        "v_vertices",
        "v_boxes",
    )
)
def a07_width_stats(spark, sf_dir):
    """40th and 90th percentile width of each line (A07, T10's widths)."""
    return linear.width_stats(_widths(spark, sf_dir)).select("line_id", F.round("avg_width", 5).alias("avg_width"), F.round("max_width", 5).alias("max_width"))


@query(
    with_views(
        _WID
        + """, s AS (SELECT line_id, round(coalesce(quantile_cont(width, 0.4) FILTER (WHERE width > 1e-6), 0.0), 6) AS w FROM wd GROUP BY line_id),
ln AS (SELECT line_id, sum(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))) AS len FROM v_segs GROUP BY line_id)
SELECT s.line_id, round(CASE WHEN w = 0 THEN (SELECT avg(w) FROM s) ELSE w END, 6) AS width, round(len * CASE WHEN w = 0 THEN (SELECT avg(w) FROM s) ELSE w END + pi() * power(CASE WHEN w = 0 THEN (SELECT avg(w) FROM s) ELSE w END / 2, 2), 4) AS footprint_area FROM s JOIN ln USING (line_id)""",
        "v_vertices",
        "v_segs",
        "v_boxes",
    )
)
def p04_fixed_footprint(spark, sf_dir):
    """Null and zero widths filled with the mean, and the area of a buffer of that width about a straight line."""
    s = linear.width_stats(_widths(spark, sf_dir), fallback=0.0).select("line_id", F.round("avg_width", 6).alias("w"))
    mean = s.agg(F.avg("w").alias("m"))
    lines = geo.lines(views.vertices(spark, sf_dir)).select("line_id", geo.length(F.col("pts")).alias("len"))
    w = F.when(F.coalesce("w", F.lit(0.0)) == 0, F.col("m")).otherwise(F.col("w"))
    return s.join(lines, "line_id").join(F.broadcast(mean)).select("line_id", F.round(w, 6).alias("width"), F.round(F.col("len") * w + F.pi() * (w / 2) ** 2, 4).alias("footprint_area"))


@query(
    with_views(
        _WID
        + """, k AS (SELECT * FROM wd WHERE width > 1e-6), e AS (SELECT line_id, min(width) AS lo0, max(width) AS hi0 FROM k GROUP BY line_id),
e2 AS (SELECT line_id, CASE WHEN hi0 > lo0 THEN lo0 ELSE lo0 - 0.5 END AS lo, CASE WHEN hi0 > lo0 THEN hi0 ELSE hi0 + 0.5 END AS hi FROM e)
SELECT line_id, CAST(sum(n) AS BIGINT) AS n_widths, CAST(count(*) AS BIGINT) AS bins_used FROM (SELECT line_id, least(floor((width - lo) / ((hi - lo) / 10)), 9) AS b, count(*) AS n FROM k JOIN e2 USING (line_id) GROUP BY 1, 2) GROUP BY line_id""",
        "v_vertices",
        "v_boxes",
    )
)
def a07_width_histogram(spark, sf_dir):
    """Ten-bin width histograms, as how many bins each line fills."""
    return linear.width_histogram(_widths(spark, sf_dir)).groupBy("line_id").agg(F.sum("n").alias("n_widths"), F.count("*").alias("bins_used"))


@query(with_views(f"SELECT line_id, CAST(coalesce(sum(greatest(ceil({_LEN}), 1)) FILTER (WHERE x2 IS NOT NULL), 0) + 1 AS BIGINT) AS n_vertices FROM v_segs GROUP BY line_id", *_SEG))
def g12_segmentize(spark, sf_dir):
    """Vertices of each line after no segment is longer than 1."""
    return geo.lines(views.vertices(spark, sf_dir)).select("line_id", F.size(geo.segmentized(F.col("pts"), 1.0)).cast("long").alias("n_vertices"))


@query(
    with_views(
        f""", c AS (SELECT line_id, seq, x1, y1, x2, y2, {_LEN} AS d, sum({_LEN}) OVER (PARTITION BY line_id ORDER BY seq) - {_LEN} AS pos, sum({_LEN}) OVER (PARTITION BY line_id) AS total FROM v_segs WHERE x2 IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq DESC) AS k FROM c WHERE pos <= total / 2)
SELECT line_id, round(x1 + (total / 2 - pos) / d * (x2 - x1), 5) AS mx, round(y1 + (total / 2 - pos) / d * (y2 - y1), 5) AS my FROM f WHERE k = 1 AND total > 0""".lstrip(),
        *_SEG,
    )
)
def g13_midpoint(spark, sf_dir):
    """The point half-way along each line."""
    m = linear.midpoints(linear.measured(views.vertices(spark, sf_dir)))
    return m.select("line_id", F.round("x", 5).alias("mx"), F.round("y", 5).alias("my"))


@query(with_views(f"SELECT line_id, CAST(floor(sum({_LEN})) + 2 AS BIGINT) AS n_samples FROM v_segs GROUP BY line_id HAVING sum({_LEN}) > 0", *_SEG))
def g14_samples(spark, sf_dir):
    """Points every unit along each line and its last vertex, counted."""
    return linear.samples(linear.measured(views.vertices(spark, sf_dir))).groupBy("line_id").agg(F.count("*").alias("n_samples"))


@query(
    with_views(
        f""", l AS (SELECT line_id, sum({_LEN}) AS len FROM v_segs GROUP BY line_id HAVING sum({_LEN}) > 0),
p AS (SELECT line_id, len, CASE WHEN len <= 3 OR len % 3 < 1 THEN 0 ELSE CAST(floor(len / 3) AS BIGINT) END AS n FROM l)
SELECT line_id, k AS part, round(CASE WHEN n = 0 THEN len ELSE least(3, len - 3 * k) END, 5) AS part_length FROM p, unnest(range(0, n + 1)) AS r(k)""".lstrip(),
        *_SEG,
    )
)
def g17_cut_lines(spark, sf_dir):
    """Lines cut every 3 units, whole where the rest is under 1."""
    v = views.vertices(spark, sf_dir, rows_a_task=500_000)
    cut = linear.cut_every(linear.measured(v), 3.0)
    d = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    return cut.groupBy("line_id", "part").agg(F.round(F.sum(d), 5).alias("part_length"))


@query(with_views(f"SELECT line_id, CAST(greatest(ceil(sum({_LEN}) / 2) - 1, 1) AS BIGINT) AS n_chords FROM v_segs GROUP BY line_id HAVING sum({_LEN}) > 0", *_SEG))
def g18_chords(spark, sf_dir):
    """Chords between evenly spaced samples, counted."""
    return linear.chords(linear.measured(views.vertices(spark, sf_dir)), 2.0).groupBy("line_id").agg(F.count("*").alias("n_chords"))


@query(
    with_views(
        """, s AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq DESC) AS back FROM v_vertices), a AS (SELECT * FROM s WHERE back = 1), b AS (SELECT * FROM s WHERE back = 2)
SELECT a.line_id, round(a.x + 2 * (a.x - b.x) / sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 5) AS anchor_x, round(a.y + 2 * (a.y - b.y) / sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 5) AS anchor_y
FROM a JOIN b USING (line_id) WHERE a.x <> b.x OR a.y <> b.y""".lstrip(),
        "v_vertices",
    )
)
def g33_anchors(spark, sf_dir):
    """A point 2 beyond each line's last vertex, in the last segment's direction."""
    a, b = F.element_at("pts", -1), F.element_at("pts", -2)
    d = F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2)
    lines = geo.lines(views.vertices(spark, sf_dir)).filter(F.size("pts") >= 2).filter(d > 0)
    return lines.select("line_id", F.round(a["x"] + 2 * (a["x"] - b["x"]) / d, 5).alias("anchor_x"), F.round(a["y"] + 2 * (a["y"] - b["y"]) / d, 5).alias("anchor_y"))


_ENDS = """, n AS (SELECT line_id, max(seq) AS top FROM v_vertices GROUP BY line_id HAVING count(*) >= 2),
ends AS (SELECT v.line_id, 0 AS e, v.x, v.y, atan2(w.y - v.y, w.x - v.x) AS angle FROM n JOIN v_vertices v ON v.line_id = n.line_id AND v.seq = 0 JOIN v_vertices w ON w.line_id = n.line_id AND w.seq = 1
  UNION ALL SELECT v.line_id, 1, v.x, v.y, atan2(w.y - v.y, w.x - v.x) FROM n JOIN v_vertices v ON v.line_id = n.line_id AND v.seq = top JOIN v_vertices w ON w.line_id = n.line_id AND w.seq = top - 1),
sn AS (SELECT *, CAST(0 AS BIGINT) AS blk, CAST(floor(x * 4) AS BIGINT) AS sx, CAST(floor(y * 4) AS BIGINT) AS sy FROM ends)"""
_EDGES = _ENDS + ", ed AS (SELECT DISTINCT p.line_id AS a, q.line_id AS b FROM sn p JOIN sn q USING (blk, sx, sy) WHERE p.line_id < q.line_id)"
_REACH = ", bo AS (SELECT a, b FROM {0} UNION SELECT b, a FROM {0}), re AS (SELECT a AS node, a AS seen FROM bo UNION SELECT re.node, bo.b FROM re JOIN bo ON re.seen = bo.a)"


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE" + sql.removeprefix("WITH")


@query(_recursive(with_views(_EDGES + _REACH.format("ed") + " SELECT n.line_id, coalesce(min(seen), n.line_id) AS component FROM n LEFT JOIN re ON n.line_id = re.node GROUP BY n.line_id", "v_vertices")))
def d05_components(spark, sf_dir):
    """Connected components of lines that share an end vertex."""
    ends = network.snapped(network.line_ends(views.vertices(spark, sf_dir)))
    return network.vertex_groups(ends).withColumnRenamed("group", "component")


_PAIRS = (
    _ENDS
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY blk, sx, sy ORDER BY line_id, e) AS k, count(*) OVER (PARTITION BY blk, sx, sy) AS n_ends FROM sn),
can AS (SELECT p.blk, p.sx, p.sy, p.line_id AS a, q.line_id AS b, q.k AS qk, row_number() OVER (PARTITION BY p.blk, p.sx, p.sy, q.k ORDER BY p.k) AS rank FROM o p JOIN o q ON p.blk = q.blk AND p.sx = q.sx AND p.sy = q.sy AND p.k < q.k
  WHERE p.n_ends = 2 OR CASE WHEN abs(p.angle - q.angle) <= pi() THEN abs(p.angle - q.angle) ELSE abs(p.angle - q.angle) - pi() END < pi() / 10 OR (abs(p.angle - q.angle) > pi() - pi() / 10 AND abs(p.angle - q.angle) < pi() + pi() / 10)),
pr AS (SELECT blk, sx, sy, a, b FROM can WHERE rank = 1)"""
)


@query(with_views(_PAIRS + " SELECT blk, sx, sy, a, b FROM pr", "v_vertices"))
def d06_connected_lines(spark, sf_dir):
    """Lines that go on into one another at a vertex, by angle."""
    return network.connected_pairs(network.snapped(network.line_ends(views.vertices(spark, sf_dir)))).select("blk", "sx", "sy", "a", "b")


@query(
    with_views(
        _PAIRS
        + """ SELECT w.blk, w.sx, w.sy, ways, coalesce(j, 0) AS joined, CASE ways WHEN 1 THEN 'SINGLE' WHEN 2 THEN 'TWO' WHEN 3 THEN 'THREE' WHEN 4 THEN 'FOUR' WHEN 5 THEN 'FIVE' ELSE 'MORE' END || '_WAY_' || coalesce(j, 0) AS vertex_class
FROM (SELECT blk, sx, sy, count(*) AS ways FROM sn GROUP BY ALL) w LEFT JOIN (SELECT blk, sx, sy, count(*) AS j FROM pr GROUP BY ALL) p ON w.blk = p.blk AND w.sx = p.sx AND w.sy = p.sy""",
        "v_vertices",
    )
)
def a20_vertex_classes(spark, sf_dir):
    """Degree and connectivity of each vertex."""
    ends = network.snapped(network.line_ends(views.vertices(spark, sf_dir)))
    return network.vertex_classes(ends, network.connected_pairs(ends)).select("blk", "sx", "sy", "ways", F.col("joined").cast("long").alias("joined"), "vertex_class")


@query(_recursive(with_views(_PAIRS + ", e2 AS (SELECT DISTINCT a, b FROM pr)" + _REACH.format("e2") + ' SELECT n.line_id, coalesce(min(seen), n.line_id) AS "group" FROM n LEFT JOIN re ON n.line_id = re.node GROUP BY n.line_id', "v_vertices")))
def t05_line_groups(spark, sf_dir):
    """Groups of lines connected by the angle rule."""
    ends = network.snapped(network.line_ends(views.vertices(spark, sf_dir)))
    return network.angle_groups(ends)


@query()
def d07_merged_lines(spark, sf_dir):
    """Each group's lines merged end to end."""
    v = views.vertices(spark, sf_dir)
    ends = network.snapped(network.line_ends(v))
    return network.merged(v, network.angle_groups(ends)).withColumn("length", F.round("length", 5))

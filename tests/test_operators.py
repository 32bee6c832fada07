"""Closed-form fixtures, invariants and brute force for the library's operators."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineament.functions import geo
from lineament.operators import lidar, linear, network, paths, raster
from lineament.operators.graph import components
from lineament.operators.spatial_join import bbox_join
from lineament.plans import registry
from lineament.sources import layers


def vertices(spark, *lines):
    return spark.createDataFrame([(k, i, float(x), float(y)) for k, pts in enumerate(lines) for i, (x, y) in enumerate(pts)], "line_id long, seq long, x double, y double")


def cells(spark, grid):
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for r, row in enumerate(grid) for c, v in enumerate(row)], "r long, c long, z double")


def test_polyline(spark):
    row = geo.lines(vertices(spark, [(0, 0), (3, 4), (3, 6)])).select(geo.length(F.col("pts")).alias("l"), geo.ends_distance(F.col("pts")).alias("d"), geo.sinuosity(F.col("pts")).alias("s")).first()
    assert row.l == 7.0 and row.d == pytest.approx(45**0.5) and row.s == pytest.approx(7 / 45**0.5)


def test_bearings(spark):
    steps = {(0, 1): 0, (1, 0): 90, (0, -1): 180, (-1, 0): 270, (0, 0): None, (3, 6): 90 - math.degrees(math.atan(2))}
    df = spark.createDataFrame([(float(x), float(y), None if b is None else float(b)) for (x, y), b in steps.items()], "x double, y double, b double")
    for r in df.select("b", geo.bearing(F.lit(0.0), F.lit(0.0), F.col("x"), F.col("y")).alias("got")).collect():
        assert (r.got is None) == (r.b is None) and (r.b is None or r.got == pytest.approx(r.b))


def test_direction_bins(spark):
    want = {22.5: "NE-SW", 67.5: "E-W", 112.5: "NW-SE", 157.5: "N-S", 202.5: "NE-SW", 337.5: "N-S"}
    df = spark.createDataFrame([(k,) for k in want], "d double")
    assert {r.d: r.g for r in df.select("d", geo.direction(F.col("d")).alias("g")).collect()} == want


def test_flat_surface(spark):
    rows = {(r.r, r.c): r for r in raster.surface_area(cells(spark, [[7] * 5] * 5)).collect()}
    assert rows[2, 2].sar == pytest.approx(8) and rows[2, 2].surface == pytest.approx(4)
    assert rows[0, 0].sar < 8


def test_cost_extremes(spark):
    full = raster.cost(cells(spark, [[9] * 6] * 6), 1, 2, 2, 0.3, 1.5)
    assert all(r.cost == pytest.approx(math.exp(1.5)) for r in full.collect())
    none = raster.cost(cells(spark, [[0] * 6] * 6), 1, 2, 2, 0.3, 1.5)
    assert all(r.cost == pytest.approx(1.0) for r in none.collect())


def test_focal_forms_agree(spark):
    rng = random.Random(3)
    grid = cells(spark, [[None if rng.random() < 0.2 else rng.random() for _ in range(17)] for _ in range(13)])
    offsets = raster.disc(3)
    key = lambda df: {(r.r, r.c): (r.focal_n, None if r.focal_mean is None else round(r.focal_mean, 9), None if r.focal_std is None else round(r.focal_std, 9)) for r in df.collect()}
    assert key(raster.focal(grid, offsets)) == key(raster.focal_tiled(grid, offsets, tile=5))


def medians(spark, values):
    return spark.createDataFrame([(1, 1, k, float(v)) for k, v in enumerate(values)], "line_id long, side int, ring int, median double")


def test_ring_scan(spark):
    hit = linear.first_change(medians(spark, [0.2, 0.6, 2.4] + [2.5] * 12), 15).first()
    assert (hit.cut_dist, hit.cut_ht) == (3.0, 2.0)
    flat = linear.first_change(medians(spark, [3.0] * 15), 15).first()
    assert (flat.cut_dist, flat.cut_ht) == (4.5, 3.0)


@pytest.mark.parametrize("length,parts", [(25, [10, 10, 5]), (20.5, [20.5]), (10, [10]), (7, [7])])
def test_cut_lines(spark, length, parts):
    cut = linear.cut_every(linear.measured(vertices(spark, [(0, 0), (length / 3, 0), (length, 0)])), 10)
    got = cut.groupBy("part").agg(F.sum(F.col("x2") - F.col("x1")).alias("d")).orderBy("part").collect()
    assert [r.d for r in got] == pytest.approx(parts)


def test_chords_and_samples(spark):
    m = linear.measured(vertices(spark, [(0, 0), (700, 0), (1200, 0)]))
    got = linear.chords(m, 500).orderBy("part").collect()
    assert [(r.x1, r.x2) for r in got] == [(0, 600), (600, 1200)]
    assert linear.samples(m, 500).orderBy("k").select("x").collect() == [(0,), (500,), (1000,), (1200,)]


def test_cell_size_and_gaps(spark):
    assert spark.range(1).select(lidar.cell_size(F.lit(12.0)).alias("c")).first().c == 0.5
    d = lambda v: spark.createDataFrame([(0, 0, v)], "px long, py long, density double")
    row = lidar.gap_fraction(d(10.0), d(5.0), 30).first()
    assert row.lpi == 0.5 and row.elai == pytest.approx(-math.cos(math.radians(15)) / 0.5 * math.log(0.5))


def test_groups_by_angle(spark):
    v = vertices(spark, [(0, 0), (5, 0)], [(5, 0), (10, 0)], [(5, 0), (5, 5)], [(50, 50), (60, 60)])
    ends = network.snapped(network.line_ends(v))
    got = {r.line_id: r.group for r in network.groups(ends.select("line_id").distinct(), network.connected_pairs(ends)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_lines_meet_whatever_their_ids(spark):
    rng = random.Random(4)
    spots = [(float(rng.randrange(12)), float(rng.randrange(12))) for _ in range(160)]
    lines = {k * 7_001: (spots[2 * k], spots[2 * k + 1]) for k in range(80) if spots[2 * k] != spots[2 * k + 1]}
    v = spark.createDataFrame([(k, i, *p) for k, pts in lines.items() for i, p in enumerate(pts)], "line_id long, seq long, x double, y double")
    ends = network.snapped(network.line_ends(v))
    up = {k: k for k in lines}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    at = {}
    for k, pts in lines.items():
        for p in pts:
            at.setdefault(p, []).append(k)
    for met in at.values():
        for k in met[1:]:
            a, b = find(met[0]), find(k)
            up[max(a, b)] = min(a, b)
    got = {r.line_id: r.group for r in network.groups(ends.select("line_id").distinct(), network.vertex_edges(ends)).collect()}
    assert got == {k: find(k) for k in lines}
    pairs = network.connected_pairs(ends)
    ways = {(r.sx / 4, r.sy / 4): r.ways for r in network.vertex_classes(ends, pairs).collect()}
    assert ways == {p: len(met) for p, met in at.items()}
    two = {tuple(sorted(met)) for met in at.values() if len(met) == 2}
    assert two and two <= {(r.a, r.b) for r in pairs.collect()}


def test_merge_across_ids(spark):
    v = vertices(spark, [(0, 0), (5, 0)], [(5, 0), (9, 0)]).withColumn("line_id", F.col("line_id") * 40_000)
    ends = network.snapped(network.line_ends(v))
    out = network.merged(v, network.groups(ends.select("line_id").distinct(), network.connected_pairs(ends))).collect()
    assert len(out) == 1 and out[0].length == 9 and out[0].n_vertices == 3


def test_merge_keeps_length(spark):
    v = vertices(spark, [(0, 0), (5, 0)], [(10, 0), (5, 0)], [(10, 0), (10, 5)])
    g = spark.createDataFrame([(k, 0) for k in range(3)], "line_id long, group long")
    out = network.merged(v, g).collect()
    assert len(out) == 1 and out[0].length == pytest.approx(15) and out[0].n_vertices == 4


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0


def test_bbox_join(spark):
    rng = random.Random(2)
    box = lambda: (lambda x, y: (x, y, x + rng.random() * 30, y + rng.random() * 30))(rng.random() * 100 - 50, rng.random() * 100 - 50)
    a, b = [(i, *box()) for i in range(40)], [(i, *box()) for i in range(40)]
    left = spark.createDataFrame(a, "i long, lx0 double, ly0 double, lx1 double, ly1 double").withColumn("__row", F.col("i"))
    right = spark.createDataFrame(b, "j long, x0 double, y0 double, x1 double, y1 double")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert sorted((r.i, r.j) for r in bbox_join(left, right).collect()) == want
    assert {r.i for r in bbox_join(left, right, how="left").collect()} == set(range(40))


def small_tables(spark, tmp_path):
    """Stored orders and lineitem: a raster of 40 rows by 100 columns and three lines on it."""
    rng = random.Random(6)
    orders = [(k, "P" if rng.random() < 0.05 else "O", 500_000 / 28 * (rng.random() * 0.8 if rng.random() < 0.9 else 20 * rng.random())) for k in range(4000)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(k, n, 1, 1, 25.0 * n + k, 3_500.0 * (3 * n + k)) for k in (20, 31, 43) for n in range(1, 4)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    z = {(k // 100, k % 100): None if s == "P" else p / 500_000 * 28 for k, s, p in orders}
    return z, {k: [((k % 90) + q / 5, k // 90 % 140 + e / 10_500) for j, _, _, _, q, e in items if j == k] for k in (20, 31, 43)}


def test_documented_canopy_cost(spark, tmp_path):
    z, _ = small_tables(spark, tmp_path)
    k = {at: int(v > 1) for at, v in z.items() if v is not None}
    got = {(r.r, r.c): (r.canopy, r.cost) for r in registry.queries()["t01_documented_canopy_cost"](spark, str(tmp_path)).collect()}
    assert set(got) == set(k)
    for (r, c), v in k.items():
        near = [k[r + i, c + j] for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9 and (r + i, c + j) in k]
        m, s = np.mean(near), np.std(near)
        far = min((math.hypot(i, j) for i in range(-10, 11) for j in range(-10, 11) if k.get((r + i, c + j))), default=10)
        mixed = ((1 + (m - s) / (m + s)) / 2 if m + s > 0 else 0) * 0.7 + max(0, 10 - far) / 10 * 0.3
        assert got[r, c] == (v, pytest.approx(math.exp(1 if v else mixed) ** 1.5, abs=2e-6))


def test_fifteen_rings(spark, tmp_path):
    z, lines = small_tables(spark, tmp_path)
    rings = {}
    for line, pts in lines.items():
        for (r, c), v in z.items():
            near = []
            for seq, ((x1, y1), (x2, y2)) in enumerate(zip(pts, pts[1:])):
                t = min(max(((c + 0.5 - x1) * (x2 - x1) + (r + 0.5 - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0), 1)
                d = math.hypot(c + 0.5 - x1 - t * (x2 - x1), r + 0.5 - y1 - t * (y2 - y1))
                near.append((round(d, 9), seq, d, np.sign((x2 - x1) * (r + 0.5 - y1) - (y2 - y1) * (c + 0.5 - x1))))
            _, _, d, side = min(near)
            if v is not None and d < 15 and side:
                rings.setdefault((line, int(side), int(d)), []).append(v)
    got = {(r.line_id, r.side, r.ring): r.median for r in registry.queries()["a05_fifteen_ring_medians"](spark, str(tmp_path)).collect()}
    assert got == {k: pytest.approx(float(np.median(v)), abs=2e-6) for k, v in rings.items()} and {k[2] for k in got} == set(range(15))
    th = lambda line, side: (lambda m: 0.3 * m if m > 1 else 1)(np.median([np.median(v) for k, v in rings.items() if k[:2] == (line, side)]))
    out = {r.line_id: r for r in registry.queries()["t06_fifteen_ring_threshold"](spark, str(tmp_path)).collect()}
    assert {k: r.DynCanTh for k, r in out.items()} == {k: pytest.approx((th(k, 1) + th(k, -1)) / 2, abs=2e-6) for k in lines}


def test_change_in_a_far_ring(spark):
    got = linear.first_change(medians(spark, [0.2] * 9 + [4.0] * 6), 15).first()
    assert (got.cut_dist, got.cut_ht) == (10.0, 4.0)


def test_all_valid_cells(spark, tmp_path):
    z, _ = small_tables(spark, tmp_path)
    got = {(r.r, r.c): r.z for r in registry.queries()["p06_drop_null"](spark, str(tmp_path)).collect()}
    assert got == {at: pytest.approx(v, abs=1e-6) for at, v in z.items() if v is not None}


def test_lines_at_the_limit_stay(spark, tmp_path):
    # a box over x 17 to 22, y 29 to 34; lines along y = 30 from x = 20.5, 1.5 of them inside
    items = [(k, n, 1, 1, 5 * (20.5 - k % 90 + (n - 1) * d), 10_500.0 * (30 - k // 90)) for k, d in ((1, 2.5), (2, 2.49), (3, 2.51)) for n in (1, 2, 3)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 0)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.line_id: (r.inside, r.mostly) for r in registry.queries()["j13_clipped_lines"](spark, str(tmp_path)).collect()}
    assert got == {1: (1.5, True), 2: (1.5, True), 3: (1.5, False)}


def plain_distance(cost, start):
    best, heap = {}, [(0.0, start)]
    while heap:
        d, (r, c) = heapq.heappop(heap)
        if (r, c) in best:
            continue
        best[r, c] = d
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                p, q = r + i, c + j
                if (i or j) and 0 <= p < cost.shape[0] and 0 <= q < cost.shape[1]:
                    heapq.heappush(heap, (d + math.hypot(i, j) * (cost[r, c] + cost[p, q]) / 2, (p, q)))
    return best


def test_paths():
    cost = np.random.default_rng(0).random((9, 12)) + 0.1
    dist, _ = paths.cost_distance(cost, [(0, 0)])
    want = plain_distance(cost, (0, 0))
    assert all(dist[k] == pytest.approx(v) for k, v in want.items())
    path, total = paths.least_cost_path(cost, (0, 0), (8, 11))
    assert path[0] == (0, 0) and path[-1] == (8, 11) and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(path, path[1:]))
    assert total <= plain_distance(cost, (0, 0))[8, 11]
    assert (paths.corridor(cost, (0, 0), (8, 11)) >= 0).all()


def test_regions():
    mask = np.array([[1, 1, 0, 0], [1, 0, 0, 1], [0, 0, 1, 1]], bool)
    labels, n = paths.label_regions(mask)
    assert n == 2 and labels[0, 0] == labels[1, 0] != labels[2, 2]
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    found = paths.outlines(ring)
    area = lambda p: abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, p[1:] + p[:1]))) / 2
    assert sorted(map(area, found)) == [1, 25] and all(len(p) == 4 for p in found)
    assert paths.simplified([(0, 0), (1, 0.01), (2, 0), (3, 5)], 0.5) == [(0, 0), (2, 0), (3, 5)]
    strip = np.zeros((7, 20), bool)
    strip[2:5] = True
    assert {r for r, c in paths.medial_path(strip) if 2 < c < 17} == {3}
    assert paths.medial_path(np.zeros((3, 3), bool)) == []


def test_reference_systems():
    layers.same_srid(2956, 2956)
    with pytest.raises(ValueError):
        layers.same_srid(2956, 4326)


def test_entry_without_corpus_modules():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 't12_line_attributes' in q and 'pipeline' not in q; e.oracle_sql()"
    root = str(__import__("pathlib").Path(__file__).resolve().parents[1])
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0


def test_wide_stencils_by_tiles(spark):
    """Stencils that go by tiles, over the borders of tiles, against brute force."""
    rng = random.Random(8)
    spots = {(r, c): None if rng.random() < 0.1 else rng.choice([0.0, 3.0, 7.0, rng.uniform(0, 9)]) for r in range(248, 266) for c in range(-12, 12)}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in spots.items()], "r long, c long, z double")
    tall = {k for k, v in spots.items() if v is not None and v > 6}
    mask = df.withColumn("canopy", F.when(F.col("z").isNull(), None).otherwise((F.col("z") > 6).cast("int")))
    got = {(r.r, r.c): r.smooth for r in raster.smooth_term(mask, 5.0).collect()}
    for k in spots:
        d = min(math.dist(k, t) for t in tall)
        assert got.get(k, 0.0) == pytest.approx(max(0.0, 5 - d) / 5)
    for widen, best in ((True, max), (False, min)):
        got = {(r.r, r.c): r.z for r in raster.morph(df, 4, widen).collect()}
        want = {(r, c): best(v for (p, q), v in spots.items() if v is not None and abs(p - r) <= 4 and abs(q - c) <= 4) for (r, c), own in spots.items() if own is not None}
        assert got == want
    window = 2 + F.col("z") / 2
    got = {(r.r, r.c) for r in lidar.tree_tops(df, window, 2.0, 5).collect()}
    high = {k: v for k, v in spots.items() if v is not None and v > 2}
    want = {k for k, v in high.items() if not any(0 < math.dist(k, o) <= (2 + v / 2) / 2 and (w, -o[0], -o[1]) > (v, -k[0], -k[1]) for o, w in high.items())}
    assert got == want and raster.morph(df.limit(0), 4, True).count() == 0


def test_transect_widths_take_the_length_as_given_and_largest_boxes(spark):
    import math

    turn = 0.3  # 20 * cos and 20 * sin, squared and added, have no root of exactly 20
    cuts = spark.createDataFrame([(1, k, 10 * math.cos(t), 10 * math.sin(t), -10 * math.cos(t), -10 * math.sin(t)) for k, t in enumerate((turn, 1.1, 2.3, 0.7))] + [(2, 0, 500.0, 500.0, 510.0, 510.0)], "line_id long, seq long, ax double, ay double, bx double, by double").withColumn("span", F.lit(20.0))
    boxes = spark.createDataFrame([(1, -50, -50, 50, 50), (2, -50, -50, 50, 50), (3, -5, -5, 5, 5)], "id long, x0 long, y0 long, x1 long, y1 long")
    widths = linear.transect_widths(cuts, boxes)
    assert {(r.line_id, r.seq): r.width for r in widths.collect()} == {(1, k): 20.0 for k in range(4)} | {(2, 0): 0.0}
    assert linear.width_histogram(widths).count() == 1


def test_maximal_boxes(spark):
    from lineament.operators.spatial_join import maximal_boxes

    rows = [(k * 17 % 23, k * 29 % 31, k * 17 % 23 + 2 + k % 7, k * 29 % 31 + 2 + k % 5) for k in range(300)]
    got = {tuple(r) for r in maximal_boxes(spark.createDataFrame(rows, "x0 long, y0 long, x1 long, y1 long")).collect()}
    inside = lambda p, q: p != q and q[0] <= p[0] and q[1] <= p[1] and p[2] <= q[2] and p[3] <= q[3]
    assert got == {p for p in set(rows) if not any(inside(p, q) for q in rows)}


@pytest.mark.parametrize("most", [10, 5])
def test_rings_by_tiles_like_pairs(spark, monkeypatch, most):
    from lineament.operators import homes

    monkeypatch.setattr(homes, "MOST", most)  # with 5, larger lines go through the join
    rng = random.Random(5)
    grid = [[None if rng.random() < 0.1 else rng.randrange(30) for _ in range(70)] for _ in range(75)]
    lines = []
    for _ in range(40):
        x, y = rng.uniform(-5, 70), rng.uniform(-5, 70)
        lines.append([(x, y)] + [(x + rng.randrange(-9, 9), y + rng.randrange(-9, 9)) for _ in range(rng.randrange(1, 6))])
    c, s = cells(spark, grid), linear.segments(vertices(spark, *lines, [(5, 5), (5, 5)], [(-200, 5), (-190, 5)]))
    s.sparkSession.conf.set("spark.sql.shuffle.partitions", "4")
    want = linear.ring_medians(linear.rings(c, s, 4))
    got = linear.line_ring_medians(c, s, 4)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(got) == rows(want)
    cut = {(r.line_id, r.side): (r.cut_dist, r.cut_ht) for r in linear.first_change(want, 4).collect()}
    for r in linear.relative_thresholds(c, s, 4).collect():
        for side, ht, dist in ((1, r.CL_CutHt, r.LDist_Cut), (-1, r.CR_CutHt, r.RDist_Cut)):
            assert cut.pop((r.line_id, side), (None, None)) == (dist, ht)
    assert not cut


def test_rings_make_no_row_for_a_line_and_a_cell(spark):
    c, s = cells(spark, [[1.0] * 40] * 40), linear.segments(vertices(spark, *[[(20, 20 + k / 100), (22, 21)] for k in range(50)]))
    plan = linear.line_ring_medians(c, s, 15)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "percentile" not in plan


def test_stacked_searches_like_a_heap():
    rng = np.random.default_rng(3)
    clipped = []
    for k in range(60):
        g = rng.integers(1, 4, rng.integers(1, 9, 2)).astype(float)  # many ties
        g[rng.random(g.shape) < 0.2] = np.nan
        if k % 20 == 19:
            g[0, 0] = 0.0
        spot = lambda: tuple(int(v) for v in rng.integers(0, g.shape))
        clipped.append(paths.Clip(g, 0, 0, spot(), spot(), {}))
    for c, got, total in zip(clipped, paths.least_cost_paths_of(clipped), paths.corridors_of(clipped)):
        assert got == paths.least_cost_path(c.g, c.a, c.b)
        assert np.array_equal(total, paths.corridor(c.g, c.a, c.b))


def test_corridor_footprints_return_their_outlines(spark):
    df = registry.queries()["t02_corridor_footprints"](spark, "/root/testdata/sf0.001")
    rows = df.filter("area > 0").limit(50).collect()
    for r in rows:
        rings = [[(p.x, p.y) for p in ring] for ring in r.rings]
        assert len(rings) == r.n_rings and len(r.centre) == r.n_centre
        area = sum(x1 * y2 - x2 * y1 for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])) / 2
        assert abs(area) == r.area


@pytest.mark.parametrize("most", [10, 5])
def test_clips_by_tiles_like_pairs(spark, monkeypatch, most):
    from lineament.operators import homes

    monkeypatch.setattr(homes, "MOST", most)
    rng = random.Random(8)
    c = cells(spark, [[None if rng.random() < 0.1 else 1 + rng.randrange(4) for _ in range(60)] for _ in range(60)]).withColumnRenamed("z", "cost").filter("r > 3 and c < 55")
    rows = [(k, rng.uniform(-3, 62), rng.uniform(-3, 62)) for k in range(40)]
    lines = spark.createDataFrame([(k, x, y, x + rng.uniform(-40, 40), y + rng.uniform(-9, 9)) for k, x, y in rows], "line_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.line_id: (r.path_cost, [tuple(p) for p in r.path]) for r in paths.least_cost_paths(c, lines, 2.0).collect()}
    want = {}
    for k, pdf in paths.clips(c, lines, 2.0).toPandas().groupby("line_id"):
        g, r0, c0, a, b = paths._grid(pdf)
        path, total = paths.least_cost_path(g, a, b)
        want[k] = (total, [(i + r0, j + c0) for i, j in path])
    assert got == want


def test_copies_of_points_and_boxes_are_met_once(spark):
    from lineament.operators.spatial_join import counts_in_boxes, near_pairs, near_places

    rng = random.Random(2)
    rows = [(k, float(rng.randrange(12)), float(rng.randrange(12))) for k in range(400)]
    p = spark.createDataFrame([*rows, (900, None, 1.0), (901, None, 1.0)], "id long, x double, y double")
    members, pairs = near_places(p, 1.2)
    assert pairs.count() < near_pairs(p, "id", 1.2).count() / 4  # pairs of places, not of points
    c = components(pairs)
    got = {r.id: r.cluster for r in members.join(c, members.place == c.node, "left").select("id", F.coalesce("component", "place").alias("cluster")).collect()}
    alone = components(near_pairs(p, "id", 1.2)).collect()
    assert got == {r[0]: r[0] for r in p.collect()} | {r.node: r.component for r in alone}
    boxes = [(k, k % 5, k % 3, k % 5 + 4, k % 3 + 4) for k in range(60)]
    n = {r.id: r.points for r in counts_in_boxes(p, spark.createDataFrame(boxes, "id long, x0 long, y0 long, x1 long, y1 long")).collect()}
    assert n == {b[0]: sum(b[1] <= x < b[3] and b[2] <= y < b[4] for _, x, y in rows) for b in boxes}


def test_ground_of_many_returns_on_one_place(spark):
    pts = [(0.0, 0.0, z, 2) for z in (3.0, 1.0, 1.0, 2.0, 9.0)] * 2 + [(1.0, 0.0, 5.0, 2)]
    g = spark.createDataFrame(pts, "x double, y double, z double, cls int")
    at = spark.createDataFrame([(1, 0.5, 2.0), (2, 0.5, 2.0), (3, 50.0, 0.0)], "id long, x double, y double")
    got = {r.id: r.ground for r in lidar.ground_height(g, at).collect()}
    assert got == {1: pytest.approx(1.0), 2: pytest.approx(1.0), 3: None}


def test_covered_lines_are_not_sorted_by_polygon(spark):
    plan = registry.queries()["j02_covered_by"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("kept", [3 << 20, 20])
def test_groups_and_components_like_joins(spark, monkeypatch, kept):
    """Stars in the task, many tasks' and one's, and joins where no task may hold the nodes, give the same."""
    from lineament.operators import graph

    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (2000, 2000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    want = {r.node: r.component for r in graph.labelled(df).collect()}
    monkeypatch.setattr(graph, "KEPT", kept)
    assert {r.node: r.component for r in graph.components(df).collect()} == want
    v = vertices(spark, *([(rng.randrange(6), rng.randrange(6)), (rng.randrange(6) + 7, rng.randrange(6))] for _ in range(40)))
    ends = network.snapped(network.line_ends(v))
    ids = ends.select("line_id").distinct()
    for got, pairs in ((network.vertex_groups(ends), network.vertex_edges(ends)), (network.angle_groups(ends), network.connected_pairs(ends))):
        assert {r.line_id: r.group for r in got.collect()} == {r.line_id: r.group for r in network.groups(ids, pairs).collect()}


def test_a_group_is_merged_by_chains(spark, monkeypatch):
    """One group of many chains goes to tasks by chain: no call of the kernel sees a line that goes on into none, and parts are counted in order."""
    rows = [[(10 * k, 0), (10 * k + 5, 0)] for k in range(40)] + [[(10 * k + 5, 0), (10 * k + 7, 0)] for k in range(0, 40, 4)] + [[(0, 50), (5, 50)], [(5, 50), (5, 60)], [(5, 60), (0, 50)]]
    v = vertices(spark, *rows)
    g = spark.createDataFrame([(k, 0) for k in range(len(rows))], "line_id long, group long")
    monkeypatch.setattr(network, "LINES", 4)
    out = {r.part: r for r in network.merged(v, g).collect()}
    assert sorted(out) == list(range(41))
    for k in range(40):
        assert (out[k].n_vertices, out[k].length) == ((3, 7.0) if k % 4 == 0 else (2, 5.0))
    assert out[40].n_vertices == 4 and out[40].length == pytest.approx(15 + math.sqrt(125))
    parts = network.merged_parts(v, g)
    assert sorted(map(tuple, (r.line_ids for r in parts.collect())))[-1] == (50, 51, 52)


def test_copies_of_boxes_are_overlaid_once(spark):
    """Overlaps and crossings are those of every box, and no side of the join is shuffled by bucket."""
    from lineament.operators import spatial_join
    from lineament.plans import join_queries

    rng = random.Random(12)
    kinds = [(x, y, x + rng.randrange(1, 30), y + rng.randrange(1, 30)) for x, y in ((rng.randrange(60), rng.randrange(60)) for _ in range(25))]
    boxes = [(k, *rng.choice(kinds)) for k in range(90)]
    holds = lambda p, q: p[1] <= q[1] and p[2] <= q[2] and p[3] >= q[3] and p[4] >= q[4]
    want = sorted((p[0], q[0], (min(p[3], q[3]) - max(p[1], q[1])) * (min(p[4], q[4]) - max(p[2], q[2]))) for p in boxes for q in boxes if p[0] < q[0] and p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4] and not holds(p, q) and not holds(q, p))
    df = spark.createDataFrame(boxes, "id long, x0 long, y0 long, x1 long, y1 long")
    assert sorted(map(tuple, spatial_join.overlapping_boxes(df).collect())) == want
    plan = join_queries.g31_crossings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(__lx" not in plan


def test_tasks_grow_with_vertices(spark):
    """A task's rows are bounded: more vertices give more tasks, and the lines stay whole in one."""
    from lineament.sources import views

    v = views.vertices(spark, "/root/testdata/sf0.001", rows_a_task=500)
    assert v.rdd.getNumPartitions() >= 12
    assert v.withColumn("p", F.spark_partition_id()).groupBy("line_id").agg(F.countDistinct("p").alias("n")).filter("n > 1").count() == 0
    assert v.exceptAll(views.vertices(spark, "/root/testdata/sf0.001")).count() == 0

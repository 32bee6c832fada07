"""Readers of LAS, GeoTIFF and GeoJSON files, on files written here."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineament.sources.geojson import read_geojson
from lineament.sources.geotiff import read_geotiff
from lineament.sources.las import LasReader, read_las


def las(points, form):
    length = {1: 28, 6: 30}[form]
    head = bytearray(375 if form == 6 else 227)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 4 if form == 6 else 2))
    struct.pack_into("<HI", head, 94, len(head), len(head))
    struct.pack_into("<BHI", head, 104, form, length, 0 if form == 6 else len(points))
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.001, 100.0, 200.0, 0.0)
    if form == 6:
        struct.pack_into("<Q", head, 247, len(points))
    body = b""
    for x, y, z, i, cls, nret, returns, overlap in points:
        spot = struct.pack("<iiiH", round((x - 100) * 100), round((y - 200) * 100), round(z * 1000), i)
        flags = struct.pack("BBB", nret | returns << 4, 8 * overlap, cls) if form == 6 else struct.pack("BB", nret | returns << 3, cls)
        body += (spot + flags).ljust(length, b"\0")
    return bytes(head) + body


@pytest.mark.parametrize("form", [1, 6])
def test_las(spark, tmp_path, form):
    points = [(100 + k / 4, 200 - k / 2, k / 8, k, 2 if k % 3 else 7, 1 + k % 3, 3, False) for k in range(50)]
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "a.las").write_bytes(las(points, form))
    (tmp_path / "b.LAS").write_bytes(las(points[:3], form))
    df = read_las(spark, str(tmp_path), run=7)
    got = sorted((r.x, r.y, r.z, r.intensity, r.cls, r.nret, r.returns, r.overlap) for r in df.collect())
    assert np.allclose(np.array(got, float), np.array(sorted(points + points[:3]), float))
    assert df.filter("cls <> 7 and z >= 2").count() == sum(p[4] != 7 and p[2] >= 2 for p in points + points[:3])


def test_las_pushes_and_refuses(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    r = LasReader({"files": "[]"})
    assert list(r.pushFilters([GreaterThan(("z",), 2.0), EqualTo(("file",), "x")])) == [EqualTo(("file",), "x")] and len(r.wanted) == 1
    (tmp_path / "x.las").write_bytes(b"nothing of the kind")
    with pytest.raises(Exception, match="no LAS"):
        read_las(spark, str(tmp_path)).count()


def tiff(z, nodata, rows, deflate, order="<"):
    height, width = z.shape
    strips = [z[i : i + rows].astype(order + "f4").tobytes() for i in range(0, height, rows)]
    strips = [zlib.compress(s) if deflate else s for s in strips]
    at, offsets, body = 8, [], b""
    for s in strips:
        offsets.append(at + len(body))
        body += s
    text = f"{nodata}".encode() + b"\0"
    fields = [(256, 4, (width,)), (257, 4, (height,)), (258, 3, (32,)), (259, 3, (8 if deflate else 1,)), (273, 4, offsets), (277, 3, (1,)), (278, 4, (rows,)), (279, 4, [len(s) for s in strips]), (339, 3, (3,)), (33550, 12, (0.5, 0.5, 0.0)), (33922, 12, (0, 0, 0, 10.0, 90.0, 0)), (42113, 2, text)]
    extra, entries, free = b"", b"", 8 + len(body) + 2 + 12 * len(fields) + 4
    for tag, kind, v in fields:
        raw = v if kind == 2 else struct.pack(f"{order}{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[kind] }", *v)
        value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", free + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack(order + "HHI", tag, kind, len(v)) + value
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(body))
    return head + body + struct.pack(order + "H", len(fields)) + entries + b"\0\0\0\0" + extra


@pytest.mark.parametrize("deflate,order", [(False, "<"), (True, ">")])
def test_geotiff(spark, tmp_path, deflate, order):
    z = np.arange(35, dtype=float).reshape(7, 5)
    z[2, 3] = -9999
    (tmp_path / "x.tif").write_bytes(tiff(z, -9999, 3, deflate, order))
    rows = {(r.r, r.c): r for r in read_geotiff(spark, str(tmp_path), run=1).collect()}
    assert len(rows) == 35 and rows[2, 3].z is None
    assert all(r.z == z[k] for k, r in rows.items() if k != (2, 3))
    assert (rows[1, 2].x, rows[1, 2].y) == (11.25, 89.25)
    assert read_geotiff(spark, str(tmp_path)).agg(F.count("z")).first()[0] == 34


def test_geojson(spark, tmp_path):
    feature = lambda i, kind, c: {"type": "Feature", "id": i, "properties": {"name": i}, "geometry": {"type": kind, "coordinates": c}}
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [feature("a", "LineString", [[0, 0], [3, 4.5]]), feature("b", "Polygon", [square]), feature("c", "MultiPolygon", [[square], [square, square]]), feature("d", "Point", [7, 8, 9]), feature("e", "MultiLineString", [[[1, 1], [2, 2]]]), feature("f", "MultiPoint", [[1, 1], [2, 2]])]
    (tmp_path / "all.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [*features, {"type": "Feature", "properties": {}, "geometry": None}]}))
    rows = sorted(read_geojson(spark, str(tmp_path / "all.geojson")).collect(), key=lambda r: (r.id, r.part))
    assert [(r.id, r.part, len(r.rings)) for r in rows] == [("a", 0, 1), ("b", 0, 1), ("c", 0, 1), ("c", 1, 2), ("d", 0, 1), ("e", 0, 1), ("f", 0, 1), ("f", 1, 1)]
    assert [(p.x, p.y) for p in rows[0].rings[0]] == [(0, 0), (3, 4.5)] and (rows[4].rings[0][0].x, rows[4].rings[0][0].y) == (7, 8) and rows[0].properties["name"] == "a"
    (tmp_path / "each.jsonl").write_text("\n".join(json.dumps(f) for f in features))
    assert read_geojson(spark, str(tmp_path / "each.jsonl"), lines=True).count() == 8

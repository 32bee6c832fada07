"""GeoJSON by Spark's own JSON expressions: collections, single features, and one feature a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURE = "type string, id string, properties map<string, string>, geometry struct<type: string, coordinates: string>"
_DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, properties, kind, part, rings): a row for each part of each feature at path.

    rings is array<array<struct<x, y>>>: a polygon's rings, a line as one ring,
    a point as one ring of one point.  A feature without a geometry has no row.
    A file is one document, read whole by a task; with `lines`, each line is a
    feature and files are split as text is.
    """
    text = spark.read.text(path, wholetext=not lines)
    doc = F.from_json("value", f"{_FEATURE}, features array<struct<{_FEATURE}>>")
    one = text.select(doc.alias("d")).filter("d is not null")
    feature = F.struct(*(F.col(f"d.{k}").alias(k) for k in ("type", "id", "properties", "geometry")))
    rows = one.select(F.explode(F.when(F.col("d.features").isNotNull(), F.col("d.features")).otherwise(F.array(feature))).alias("f")).select("f.id", "f.properties", "f.geometry.type", "f.geometry.coordinates")
    rows = rows.filter("coordinates is not null")
    spot = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ring = lambda r: F.transform(r, spot)
    parse = lambda depth: F.from_json("coordinates", "array<" * (depth + 1) + "double" + ">" * (depth + 1))
    parts = {
        "Point": F.array(F.array(F.array(spot(parse(0))))),
        "MultiPoint": F.transform(parse(1), lambda p: F.array(F.array(spot(p)))),
        "LineString": F.array(F.array(ring(parse(1)))),
        "MultiLineString": F.transform(parse(2), lambda r: F.array(ring(r))),
        "Polygon": F.array(F.transform(parse(2), ring)),
        "MultiPolygon": F.transform(parse(3), lambda p: F.transform(p, ring)),
    }
    kind = "array<array<array<struct<x: double, y: double>>>>"
    chosen = F.coalesce(*(F.when(F.col("type") == k, v.cast(kind)) for k, v in parts.items()))
    return rows.select("id", "properties", F.col("type").alias("kind"), F.posexplode(chosen).alias("part", "rings"))

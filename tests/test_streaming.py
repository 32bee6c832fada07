"""Streams against the same aggregates in one go."""

from pyspark.sql import functions as F

from lineament.streaming import incremental


def test_folded_points(spark, tmp_path):
    points = spark.createDataFrame([(i * 0.7, i * 0.3, float(i)) for i in range(40)], "x double, y double, z double")
    for k in range(3):
        points.filter(F.col("z") % 3 == k).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = incremental.fold_points(stream, str(tmp_path / "out"), 5.0, str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = incremental.merged_sums(spark.read.parquet(str(tmp_path / "out")).drop("batch"))
    key = lambda df: sorted((r.px, r.py, r.n, round(r.z_sum, 6), r.z_max) for r in df.collect())
    assert key(got) == key(incremental.pixel_sums(points, 5.0))


def test_event_windows(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert incremental.event_windows(events).agg(F.sum("n")).first()[0] == events.count()

"""Readers and sinks: layers, tiles, task lists and format rewrites, all by Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """Layers of one file, as partitions by layer; columns that a layer lacks are null."""
    out = None
    for name, df in layers.items():
        part = df.withColumn("layer", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    out.write.mode("overwrite").partitionBy("layer").parquet(path)


def read_layer(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """One layer; other layers' files aren't opened."""
    return spark.read.parquet(path).filter(F.col("layer") == layer).drop("layer")


def write_task_csv(tasks: DataFrame, path: str) -> None:
    tasks.write.mode("overwrite").option("header", True).csv(path)


def read_task_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_project(tasks: DataFrame, tool: str, path: str) -> None:
    """A JSON line a task group: {tool_api, tasks: [..]}, grouped by its first column."""
    key, *rest = tasks.columns
    tasks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("tasks")).withColumn("tool_api", F.lit(tool)).write.mode("overwrite").json(path)


def read_project(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The tasks of a project, one a row, with what groups them."""
    df = spark.read.schema(schema).json(path)
    return df.select(*(c for c in df.columns if c != "tasks"), F.explode("tasks").alias("t")).select(*(c for c in df.columns if c != "tasks"), "t.*")


def same_srid(a: int | None, b: int | None) -> None:
    """Raises if two layers' reference systems differ; nothing is reprojected."""
    if a is None or b is None or a != b:
        raise ValueError(f"layers of different reference systems: {a} and {b}")

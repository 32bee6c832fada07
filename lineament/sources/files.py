"""What the binary readers share: listing files of any store that Spark knows, and opening them in a task."""

from __future__ import annotations

from pyspark.sql import SparkSession


def listed(spark: SparkSession, path: str, *endings: str) -> list[str]:
    """The files at or under a path, those in folders below too, in order; hidden ones and other endings left out."""
    return [p for p, _ in listed_sizes(spark, path, *endings)]


def listed_sizes(spark: SparkSession, path: str, *endings: str) -> list[tuple[str, int]]:
    """listed() with the bytes of each file."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = [], store.listFiles(at, True)
    while files.hasNext():
        s = files.next()
        name = s.getPath().getName()
        if s.getLen() and name[0] not in "._" and (not endings or name.lower().endswith(endings)):
            found.append((s.getPath().toString(), s.getLen()))
    return sorted(found)


def opened(path: str):
    """A binary stream that can seek; local and mounted files directly, other stores through Arrow's file systems."""
    if path.startswith("file:") or "://" not in path:
        local = path.removeprefix("file:")
        return open("/" + local.lstrip("/") if path.startswith("file:") else local, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)

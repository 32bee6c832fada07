"""A Python data source for LAS point clouds (1.0 to 1.4, not compressed).

Partitions are runs of points of a file, planned from its header alone, so a
file of any size is read by many tasks.  Filters on class and height are pushed
to the reader and decide before rows are made.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from lineament.sources.files import listed, opened

SCHEMA = "x double, y double, z double, intensity int, cls int, nret int, returns int, overlap boolean, file string"
#: Points of a partition.
RUN = 1_000_000
_COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


class Header:
    """Where a file's points lie and how they are scaled."""

    def __init__(self, path: str):
        with opened(path) as f:
            raw = f.read(375)
        if raw[:4] != b"LASF":
            raise ValueError(f"{path} is no LAS file")
        self.offset = struct.unpack_from("<I", raw, 96)[0]
        self.format, self.length, self.count = struct.unpack_from("<BHI", raw, 104)
        if self.format & 0xC0:
            raise ValueError(f"{path} is compressed; write it as LAS first")
        if (raw[24], raw[25]) >= (1, 4):
            self.count = struct.unpack_from("<Q", raw, 247)[0] or self.count
        self.scale, self.shift = np.array(struct.unpack_from("<3d", raw, 131)), np.array(struct.unpack_from("<3d", raw, 155))


class Points(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class LasReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"])
        self.run = int(options.get("run", RUN))
        self.wanted: list[tuple[str, type, float]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in _COMPARE and name in ("z", "cls") and isinstance(f.value, (int, float)):
                self.wanted.append((name, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Points]:
        out = []
        for path in self.files:
            n = Header(path).count
            out += [Points(path, i, min(self.run, n - i)) for i in range(0, n, self.run)]
        return out or [Points("", 0, 0)]

    def read(self, p: Points) -> Iterator[pa.RecordBatch]:
        if not p.count:
            return
        h = Header(p.path)
        new = h.format >= 6
        kind = np.dtype({"names": ["x", "y", "z", "i", "r", "f", "c"], "formats": ["<i4", "<i4", "<i4", "<u2", "u1", "u1", "u1"], "offsets": [0, 4, 8, 12, 14, 15, 16 if new else 15], "itemsize": h.length})
        with opened(p.path) as f:
            for first in range(p.first, p.first + p.count, 65_536):
                n = min(65_536, p.first + p.count - first)
                f.seek(h.offset + first * h.length)
                rows = np.frombuffer(f.read(n * h.length), kind)
                cls = rows["c"].astype(np.int32) if new else (rows["c"] & 31).astype(np.int32)
                z = rows["z"] * h.scale[2] + h.shift[2]
                keep = np.ones(n, bool)
                for name, test, value in self.wanted:
                    keep &= _COMPARE[test](z if name == "z" else cls, value)
                r = rows["r"].astype(np.int32)
                nret, returns = (r & 15, r >> 4) if new else (r & 7, r >> 3 & 7)
                overlap = (rows["f"] & 8 > 0) if new else cls == 12
                columns = [rows["x"] * h.scale[0] + h.shift[0], rows["y"] * h.scale[1] + h.shift[1], z, rows["i"].astype(np.int32), cls, nret, returns, overlap]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in columns), pa.array([p.path] * int(keep.sum()), pa.string())], names=["x", "y", "z", "intensity", "cls", "nret", "returns", "overlap", "file"])


class LasSource(DataSource):
    """Options: files, a JSON list of paths; run, the points of a partition."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(dict(self.options))


def read_las(spark: SparkSession, path: str, run: int = RUN) -> DataFrame:
    """The returns of all LAS files at or under a path; turns spark.sql.python.filterPushdown.enabled on for the session, which the reader needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasSource)
    return spark.read.format("las").option("files", json.dumps(listed(spark, path, ".las"))).option("run", run).load()

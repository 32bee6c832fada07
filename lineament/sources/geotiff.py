"""A Python data source for one-band GeoTIFFs as cells (r, c, z): strips or tiles, plain or deflated.

Partitions are runs of blocks, planned from the file's directory alone.  The
stored nodata value becomes null.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lineament.sources.files import listed, opened

SCHEMA = "r long, c long, z double, x double, y double, file string"
#: Blocks of a partition.
RUN = 64
# fixed values: sizes of TIFF's field types, and numpy's letters for its sample formats
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
LETTERS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
SAMPLES = {1: "u", 2: "i", 3: "f"}


class Directory:
    """The first image of a TIFF: its size, blocks, sample type, nodata, and where its first corner lies."""

    def __init__(self, path: str):
        with opened(path) as f:
            head = f.read(8)
            self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
            if not self.order or struct.unpack(self.order + "H", head[2:4])[0] != 42:
                raise ValueError(f"{path} is no TIFF")
            f.seek(struct.unpack(self.order + "I", head[4:8])[0])
            n = struct.unpack(self.order + "H", f.read(2))[0]
            raw, tags = f.read(12 * n), {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(self.order + "HHI", raw, 12 * i)
                if kind not in LETTERS:
                    continue
                size = SIZES[kind] * count
                body = raw[12 * i + 8 : 12 * i + 8 + size]
                if size > 4:
                    f.seek(struct.unpack_from(self.order + "I", raw, 12 * i + 8)[0])
                    body = f.read(size)
                tags[tag] = body.split(b"\0")[0].decode() if kind == 2 else struct.unpack(f"{self.order}{count}{LETTERS[kind]}", body)
        one = lambda tag, default: tags.get(tag, (default,))[0]
        self.width, self.height, self.compression = one(256, 0), one(257, 0), one(259, 1)
        if self.compression not in (1, 8, 32946) or one(317, 1) != 1 or one(277, 1) != 1:
            raise ValueError(f"{path}: only one band, plain or deflated without a predictor, is read")
        self.kind = np.dtype(f"{self.order}{SAMPLES[one(339, 1)]}{one(258, 8) // 8}")
        self.block = (one(323, 0), one(322, 0)) if 322 in tags else (min(one(278, self.height), self.height), self.width)
        self.offsets, self.sizes = tags.get(324) or tags[273], tags.get(325) or tags[279]
        self.nodata = float(tags[42113]) if 42113 in tags else None
        scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
        self.x0, self.y0, self.dx, self.dy = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1]


class Blocks(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class TiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files, self.run = json.loads(options["files"]), int(options.get("run", RUN))

    def partitions(self) -> list[Blocks]:
        out = []
        for path in self.files:
            n = len(Directory(path).offsets)
            out += [Blocks(path, i, min(self.run, n - i)) for i in range(0, n, self.run)]
        return out or [Blocks("", 0, 0)]

    def read(self, p: Blocks) -> Iterator[pa.RecordBatch]:
        if not p.count:
            return
        d = Directory(p.path)
        rows, cols = d.block
        across = -(-d.width // cols)
        with opened(p.path) as f:
            for k in range(p.first, p.first + p.count):
                f.seek(d.offsets[k])
                body = f.read(d.sizes[k])
                if d.compression != 1:
                    body = zlib.decompress(body)
                z = np.frombuffer(body, d.kind)
                z = z[: len(z) // cols * cols].reshape(-1, cols).astype(float)
                r0, c0 = k // across * rows, k % across * cols
                z = z[: d.height - r0, : d.width - c0]
                r, c = (i.ravel() for i in np.indices(z.shape))
                v = z.ravel()
                empty = np.isnan(v) | (v == d.nodata if d.nodata is not None else False)
                r, c = r + r0, c + c0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r), pa.array(c), pa.array(v, mask=empty), pa.array(d.x0 + (c + 0.5) * d.dx), pa.array(d.y0 - (r + 0.5) * d.dy), pa.array([p.path] * len(v), pa.string())], names=["r", "c", "z", "x", "y", "file"]
                )


class TiffSource(DataSource):
    """Options: files, a JSON list of paths; run, the blocks of a partition."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))


def read_geotiff(spark: SparkSession, path: str, run: int = RUN) -> DataFrame:
    """The cells of all TIFF files at or under a path; x and y are cells' centres."""
    spark.dataSource.register(TiffSource)
    return spark.read.format("geotiff").option("files", json.dumps(listed(spark, path, ".tif", ".tiff"))).option("run", run).load()

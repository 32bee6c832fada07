"""WARC archives: a Python data source that reads them and a sink that writes them.

The reader plans a partition for each file, or for several small ones.  Each record's header is parsed first;
predicates on the record's type and on its headers are pushed down and decide,
before anything of the block is touched, whether it is read, and with
payload=false no block is.  Blocks that aren't wanted are sought past.

Records are written by Spark's text sink, whose line separator is the WARC
record's end, so archives can go to any store that Spark writes to.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from lineament.plans.storage import sized, written
from lineament.sources.files import listed_sizes, opened

#: Output columns that stand for a header.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type"}
SCHEMA = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in HEADERS),
        T.StructField("payload_length", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("file", T.StringType()),
        T.StructField("position", T.LongType()),
    ]
)
BATCH_BYTES = 8 << 20
#: Bytes of the small files that are read by one task.
TOGETHER = 32 << 20


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _opened(path: str):
    f = opened(path)
    return gzip.GzipFile(fileobj=f) if path.endswith(".gz") else f


def _header(f) -> dict[str, str] | None:
    """The next record's header lines, or None at the end of the file; names in lower case."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    out, last = {}, None
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            out[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _http(f, size: int) -> tuple[dict[str, str], int]:
    """An HTTP block's header, and its bytes."""
    used, out = 0, {}
    while used < size:
        line = f.readline(size - used)
        used += len(line)
        if line in (b"\r\n", b"\n", b""):
            break
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out, used


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = [tuple(f) for f in json.loads(options["files"])]
        self.payload = options.get("payload", "true").lower() != "false"
        self.wanted: list[tuple[str, frozenset[str] | None]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0].lower() if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((HEADERS[name].lower(), frozenset([f.value])))
            elif isinstance(f, In):
                self.wanted.append((HEADERS[name].lower(), frozenset(f.value)))
            elif isinstance(f, IsNotNull):
                self.wanted.append((HEADERS[name].lower(), None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        out, size = [Files([])], 0
        for path, n in self.files:
            if out[-1].files and size + n > TOGETHER:
                out.append(Files([]))
                size = 0
            out[-1].files.append(path)
            size += n
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.string()) for c in HEADERS), ("payload_length", pa.int64()), ("payload", pa.binary()), ("headers", pa.map_(pa.string(), pa.string())), ("file", pa.string()), ("position", pa.int64())])
        rows, size = [], 0
        for path in partition.files:
            with _opened(path) as f:
                while True:
                    at = f.tell()
                    head = _header(f)
                    if head is None:
                        break
                    length = int(head.get("content-length", 0))
                    if any((v := head.get(k)) is None or (only is not None and v not in only) for k, only in self.wanted):
                        f.seek(length, 1)
                        continue
                    stored, body = length, None
                    if head.get("content-type", "").startswith("application/http"):
                        http, used = _http(f, length)
                        stored, length = int(http.get("content-length", length - used)), length - used
                    if self.payload:
                        body = f.read(length)
                        size += length
                    else:
                        f.seek(length, 1)
                    rows.append((*(head.get(h.lower()) for h in HEADERS.values()), stored, body, list(head.items()), path, at))
                    if size >= BATCH_BYTES or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, s.type) for x, s in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, s.type) for x, s in zip(zip(*rows), schema)], schema=schema)


class WarcSource(DataSource):
    """Options: files, a JSON list of (path, bytes); payload=false leaves blocks unread."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the files at or under path, those in folders below too; filters on the columns that stand for headers are pushed to the reader.

    Turns spark.sql.python.filterPushdown.enabled on for the session, which the
    reader needs.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("files", json.dumps(listed_sizes(spark, path))).option("payload", str(payload).lower()).load()


def base32(hex_digest):
    """RFC 4648 base 32 of a hexadecimal column of 40 digits, without leaving Spark's expressions."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(column):
    """A header value on one line."""
    return F.regexp_replace(F.regexp_replace(column, "\r", "%0D"), "\n", "%0A")


def write_warc(records: DataFrame, path: str, record_id: str, payload: str, uri: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", compression: str = "none") -> None:
    """One response or revisit record a row of records, under path.

    Of rows whose payloads of at least least_bytes bytes are equal, those with
    the least record_id are responses and the others revisits of it; smaller
    payloads are all responses.  A null payload is empty, a row with a null id
    is never the one referred to unless all of its payload's rows are, and a
    null uri has no header.  Rows with equal ids and payloads are alike.  Only
    digests are grouped; payloads stay where they are as long as the repeated
    digests, which are counted, are few enough to send, else they are shuffled
    once by digest.
    """
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = records.select(F.col(record_id).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"), text.alias("body"))
    rows = rows.select("id", "uri", "body", F.sha1(F.col("body").cast("binary")).alias("digest"), F.octet_length("body").cast("long").alias("bytes"))
    many = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    many = written(many.filter("n > 1").select("digest", F.col("bytes").alias("of_bytes"), "first"), "repeats")
    rows = rows.join(sized(many, 96), "digest", "left")
    again = F.col("first").isNotNull() & (F.col("bytes") == F.col("of_bytes")) & ((F.col("id") != F.col("first")) | F.col("id").isNull())
    name = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _line(F.col("uri"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("digest"))),
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))).cast("string")),
    )
    record = F.concat(head, F.lit("\r\n\r\n"), http, F.when(again, "").otherwise(F.col("body")))
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def number(column):
    """The id inside a record's name."""
    return F.regexp_extract(column, r"^<urn:record:(-?\d+)>$", 1).try_cast("long")

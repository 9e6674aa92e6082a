"""WARC archives as a PySpark Python data source, with revisit records for repeated payloads.

Reading plans partitions over the archive's committed files, takes equality,
``IN`` and prefix predicates on the record type and on the other columns that come
from headers, and parses a record's headers before anything else. A payload is
inflated only if its record passes and the requested schema has a column that
needs it (``payload``, ``payload_bytes`` of a response, ``content_digest``);
otherwise the reader jumps over it: each record is a gzip member of its own whose
header carries its length in an "sl" extra field, so ordinary gzip tools read the
files too, and members without the field are inflated to find their end.

Writing puts each task's records into files of about ``FILE_BYTES``, named by a
random id, and commits a manifest of the files of the tasks that succeeded, so
what failed or repeated attempts left behind is never read.

Defined results: null payloads are empty; a null or odd URL is percent-encoded;
records without payload (revisits) report the length and digest their headers
state. An empty table gives an archive without files. Files that are cut short
or whose payload doesn't match its digest raise ``BadArchive``. A payload may be as
long as Spark's binary values; its record is held in memory while it is written.
Repeated rows are records each. Other columns of the pages aren't read, whatever
their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import joined_hot, scratch, table, written

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, headers map<string,string>, content_digest string, payload binary"
WRITES = "record_id string, record_type string, target_uri string, refers_to string, payload binary"
#: Columns that come from headers alone, by header.
FROM_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
FILE_BYTES, LEVEL, DATE = 64 << 20, 1, "2024-01-01T00:00:00Z"
_GZIP = struct.Struct("<2sBBIBBHccHII")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadArchive(ValueError):
    """Bytes that aren't a WARC record."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(raw: bytes, level: int = LEVEL) -> bytes:
    """A gzip member that states its own length in an extra field, if 32 bits can say it."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = _GZIP.size + len(body) + 8
    if size >= 1 << 32:  # readers then inflate it to find its end
        head = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"
    else:
        head = _GZIP.pack(b"\x1f\x8b", 8, 4, 0, 0, 255, 12, b"s", b"l", 8, size, len(raw) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def stated_length(data: memoryview) -> int:
    """The member's length as its "sl" field states it; 0 without one."""
    if len(data) >= 12 and data[3] & 4:
        at, end = 12, 12 + int.from_bytes(data[10:12], "little")
        while at + 4 <= end <= len(data):
            size = int.from_bytes(data[at + 2 : at + 4], "little")
            if bytes(data[at : at + 2]) == b"sl" and size >= 4:
                return int.from_bytes(data[at + 4 : at + 8], "little")
            at += 4 + size
    return 0


def record(record_id: str, record_type: str, uri: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """An uncompressed WARC record of an HTTP response with this payload, or a revisit of another record with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", urllib.parse.quote(uri or "", safe=";/?:@&=+$,#[]!'()*~%")), ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)), ("WARC-Payload-Length", str(len(payload)))]
    if record_type == "revisit":
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def headers_of(raw: bytes) -> dict[str, str]:
    """Lower-cased names and values of a record's header lines; continuation lines belong to the line before."""
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise BadArchive("a record doesn't begin with its version")
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def scan(data: bytes, wanted: object, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records of gzip members for whose headers ``wanted`` is true; payload None if not asked for or not there."""
    at, view = 0, memoryview(data)
    while at < len(data):
        stated = stated_length(view[at:])
        if stated > len(data) - at:
            raise BadArchive("a record is cut short")
        z = zlib.decompressobj(31)
        raw, rest = b"", view[at : at + stated] if stated else view[at:]
        while (end := raw.find(b"\r\n\r\n")) < 0 and not z.eof:  # headers first
            step = z.decompress(rest, 2048)
            raw, rest = raw + step, z.unconsumed_tail
            if not step and not z.eof:
                raise BadArchive("a record is cut short")
        if end < 0:
            raise BadArchive("a record has no end of headers")
        headers = headers_of(raw[:end])
        take = wanted(headers)
        body = payloads and take and headers.get("warc-type") != "revisit"
        if body or not stated:
            if not z.eof:
                raw += z.decompress(rest)
            if not z.eof:
                raise BadArchive("a record is cut short")
        at += stated or len(data) - at - len(z.unused_data)
        if take:
            payload = None
            if body:
                block = raw[end + 4 : end + 4 + int(headers["content-length"])]
                if len(block) != int(headers["content-length"]):
                    raise BadArchive("a record is cut short")
                payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
                digest = headers.get("warc-payload-digest", "")
                if digest.startswith("sha1:") and digest[5:] != sha1_base32(payload):
                    raise BadArchive("a payload doesn't match its digest")
            yield headers, payload


def value(column: str, headers: dict[str, str]) -> str | None:
    """A header column's value: ids without angle brackets, digests without their algorithm."""
    v = headers.get(FROM_HEADERS[column])
    if v is None:
        return None
    return v.strip("<>") if column in ("record_id", "refers_to") else v.removeprefix("sha1:") if column == "payload_digest" else v


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, target: int):
        self.path, self.columns, self.schema, self.target = path, schema.names, schema, target
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in FROM_HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", (f.value,)))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "any", ()))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _fs(self.path)
        with fs.open_input_stream(f"{root}/manifest.json") as s:
            files = json.loads(s.read())
        out: list[Files] = []
        size = 0
        for name, n in sorted(files, key=lambda f: f[0]):
            if not out or size + n > self.target:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += n
        return out or [Files([])]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for column, how, values in self.tests:
            v = value(column, headers)
            if v is None or how == "in" and v not in values or how == "prefix" and not v.startswith(values[0]):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, root = _fs(self.path)
        need = bool({"payload", "content_digest", "payload_bytes"} & set(self.columns))
        schema = to_arrow_schema(self.schema)
        for name in partition.names:
            with fs.open_input_stream(f"{root}/{name}", compression=None) as s:
                data = s.read()
            rows: list[list] = []
            size = 0
            for headers, payload in scan(data, self._wanted, need):
                row = []
                for c in self.columns:
                    if c in FROM_HEADERS:
                        row.append(value(c, headers))
                    elif c == "headers":
                        row.append(list(headers.items()))
                    elif c == "payload":
                        row.append(payload)
                    elif c == "payload_bytes":
                        row.append(len(payload) if payload is not None else int(headers["warc-payload-length"]) if "warc-payload-length" in headers else None)
                    elif c == "content_digest":
                        row.append(None if payload is None else sha1_base32(payload))
                    else:
                        raise ValueError(f"no column {c}; there are {SCHEMA}")
                rows.append(row)
                size += len(payload or b"") if "payload" in self.columns else 200
                if len(rows) == 2000 or size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                raw = member(record(row["record_id"], row["record_type"], row["target_uri"], row["payload"] or b"", row["refers_to"]))
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                out.write(raw)
                size += len(raw)
                if size >= FILE_BYTES:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest.json", compression=None) as s:
            s.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """``spark.read.format("warc").schema(some of SCHEMA).load(path)``, ``df.write.format("warc").mode("append").save(path)`` with the columns of WRITES."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partitionBytes", 32 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Rows to write, one for each page: of payloads of at least ``min_bytes`` that are equal, the largest id's is the response and the others revisit it.

    Equal means equal SHA-1 and length. Pages that repeat an id and its payload
    are responses each; a page with a null id revisits the response of its payload
    if there is one. Digests are grouped without payloads; only payloads that
    another page shares look their response up, and those of one page in ``HOT`` or
    more find it where they are.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    own = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("target_uri"), payload.alias("payload")).withColumn("_sha", F.unhex(F.sha1("payload"))).withColumn("_n", F.length("payload"))
    groups = own.where(F.col("_n") >= min_bytes).select("_id", "_sha", "_n").groupBy("_sha", "_n").agg(F.max("_id").alias("_head"), F.count("*").alias("_c")).where("_c > 1")
    met = joined_hot(own, written(groups, "heads"), ["_sha", "_n"], "_c")
    again = F.col("_head").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_head"))
    name = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return met.select(name("_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(again, name("_head")).alias("refers_to"), "payload")


def written_archive(rows: DataFrame, name: str = "warc") -> str:
    """The path of an archive of these rows in the shared folder."""
    spark = rows.sparkSession
    register(spark)
    path = scratch(spark, name)
    rows.write.format("warc").mode("append").option("path", path).save()
    return path


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written_archive(records(table(spark, sf_dir, "pages", "page_id", "url", "html")))
    read = spark.read.format("warc").schema("record_id string, record_type string, payload_digest string, payload_bytes long, refers_to string, content_digest string").load(path)
    number = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+)$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return read.select(as_id("record_id").alias("page_id"), "payload_bytes", F.coalesce("content_digest", "payload_digest").alias("payload_digest"), "record_type", as_id("refers_to").alias("refers_to"))

"""WARC as a PySpark Python data source: format "warc", for reading and writing.

Reading plans partitions from files, takes filters on the record type and on headers, and
parses headers first.  A record that the filters refuse, or a payload that the schema
doesn't ask for, is skipped: by its Content-Length in a plain file, by the member length
in a file whose gzip members tell it (the "sl" extra field), else by inflating on without
keeping anything.

Writing gives each task its own files of about FILE_BYTES, one gzip member a record with
that extra field; the commit writes a list of the files of the tasks that succeeded, and
reading a folder follows its list, so attempts that were lost leave nothing behind.
Paths are URIs of any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

FILE_BYTES = 64 << 20
#: Files in one read partition add up to this.
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
LIST = "_files.json"
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, payload binary"
_HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length", "refers_to": "warc-refers-to"}
_GZIP = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
_PEEK = 4096


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def record_bytes(row: dict, date: str) -> bytes:
    """A response (HTTP head and payload) or a revisit (HTTP head only) in WARC/1.1."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_length"]
    body += b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row.get('date') or date}"]
    if row["target_uri"] is not None:
        head.append("WARC-Target-URI: " + " ".join(row["target_uri"].split()))
    head += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_length']}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{row['refers_to']}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    """One gzip member whose extra field tells its own and the inflated length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = len(_GZIP) + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return _GZIP + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_head(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.split(b"\r\n")[1:]:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def http_payload(block: bytes) -> bytes:
    """What follows the HTTP head of a block; a block without one is the payload itself."""
    if not block.startswith(b"HTTP/"):
        return block
    return block.partition(b"\r\n\r\n")[2]


class _Member:
    """A member of a gzip file, inflated no further than asked; with a length of its own (``end``) it holds one record."""

    def __init__(self, f, at: int):
        self.f, self.at = f, at
        f.seek(at)
        first = f.read(_PEEK)
        self.end = None
        self.got = b""
        if not first:
            self.empty = True
            return
        self.empty = False
        if first[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {at}")
        if first[3] & 4:
            (n,), k = struct.unpack("<H", first[10:12]), 12
            while k < 12 + n:
                size = struct.unpack("<H", first[k + 2 : k + 4])[0]
                if first[k : k + 2] == b"sl" and size == 8:
                    self.end = at + struct.unpack("<I", first[k + 4 : k + 8])[0]
                k += 4 + size
        self.z = zlib.decompressobj(31)
        self.raw, self.pos = first, at + len(first)

    def more(self) -> bool:
        if self.z.eof:
            return False
        raw = self.raw or self.f.read(1 << 16)
        self.raw = b""
        if not raw:
            raise ValueError(f"gzip member at byte {self.at} is cut short")
        self.pos = self.f.tell()
        self.got += self.z.decompress(raw)
        return True

    def head(self) -> bytes:
        """The next record's head, taken off."""
        while b"\r\n\r\n" not in self.got and self.more():
            pass
        out, _, self.got = self.got.partition(b"\r\n\r\n")
        return out

    def take(self, n: int, keep: bool = True) -> bytes:
        """The next n bytes, or nothing if they are only passed over."""
        parts, have = [], 0
        while True:
            own, self.got = self.got[: n - have], self.got[n - have :]
            have += len(own)
            if keep:
                parts.append(own)
            if have == n or not self.more():
                return b"".join(parts)

    def ended(self) -> bool:
        """Is nothing left but line breaks?"""
        while True:
            self.got = self.got.lstrip(b"\r\n")
            if self.got:
                return False
            if not self.more():
                return True

    def next_at(self) -> int:
        if self.end is not None:
            return self.end
        while not self.z.eof:
            self.more()
            self.got = b""
        return self.pos - len(self.z.unused_data)


def records(f, want, payload: bool, stats: dict | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload or None) of the records that ``want(headers)`` accepts, from a plain or gzip file."""
    f.seek(0)
    gz, at = f.read(2) == b"\x1f\x8b", 0
    while True:
        if gz:
            m = _Member(f, at)
            if m.empty:
                return
            while True:
                head = parse_head(m.head())
                size = int(head.get("content-length", 0))
                if want(head):
                    yield head, http_payload(m.take(size)) if payload else None
                    if stats is not None and payload:
                        stats["decoded"] = stats.get("decoded", 0) + 1
                    if not payload and m.end is None:
                        m.take(size, keep=False)
                elif m.end is None:
                    m.take(size, keep=False)
                if m.end is not None or m.ended():  # other writers may put many records in a member
                    break
            at = m.next_at()
            continue
        f.seek(at)
        data = f.read(_PEEK)
        while data[:4] in (b"\r\n\r\n"[: len(data[:4])],) and data:  # blank lines between records
            data, at = data[2:], at + 2
        if not data.strip():
            return
        while b"\r\n\r\n" not in data:
            more = f.read(_PEEK)
            if not more:
                raise ValueError(f"the header at byte {at} is cut short")
            data += more
        n = data.index(b"\r\n\r\n") + 4
        head = parse_head(data[: n - 4])
        size = int(head.get("content-length", 0))
        if want(head):
            body = None
            if payload:
                f.seek(at + n)
                body = http_payload(f.read(size))
                if stats is not None:
                    stats["decoded"] = stats.get("decoded", 0) + 1
            yield head, body
        at += n + size + 4


def _value(head: dict[str, str], column: str):
    v = head.get(_HEADER[column])
    if v is None:
        return int(head.get("content-length", 0)) if column == "payload_length" else None
    if column in ("record_id", "refers_to"):
        return v.strip("<>")
    if column == "payload_digest":
        return v.removeprefix("sha1:")
    return int(v) if column == "payload_length" else v


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = schema.names
        self.path = options["path"]
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for x in filters:
            column = x.attribute[0] if getattr(x, "attribute", None) else None
            if column in _HEADER and isinstance(x, EqualTo):
                self.tests.append((column, "in", (x.value,)))
            elif column in _HEADER and isinstance(x, In):
                self.tests.append((column, "in", tuple(x.value)))
            elif column in _HEADER and isinstance(x, StringStartsWith):
                self.tests.append((column, "starts", (x.value,)))
            elif column in _HEADER and isinstance(x, IsNotNull):
                self.tests.append((column, "there", ()))
            else:
                yield x

    def partitions(self):
        system, root = _open(self.path)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [_Files((root,))]
        listed = f"{root}/{LIST}"
        if system.get_file_info(listed).type == pafs.FileType.File:
            with system.open_input_stream(listed) as f:
                files = [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
        else:
            found = system.get_file_info(pafs.FileSelector(root, recursive=True))
            files = [(x.path, x.size) for x in found if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz"))]
        out, own, total = [], [], 0
        for name, size in sorted(files):
            if own and total + size > SPLIT_BYTES:
                out.append(_Files(tuple(own)))
                own, total = [], 0
            own.append(name)
            total += size
        return [*out, _Files(tuple(own))]

    def _want(self, head: dict[str, str]) -> bool:
        for column, how, values in self.tests:
            v = _value(head, column)
            if v is None or how == "in" and v not in values or how == "starts" and not v.startswith(values):
                return False
        return True

    def read(self, partition):
        system, _ = _open(self.path)
        schema = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c == "payload_length" else pa.string()) for c in self.columns])
        payload = "payload" in self.columns
        held, size = [], 0
        for name in partition.paths:
            with system.open_input_file(name) as f:
                for head, body in records(f, self._want, payload):
                    held.append([body if c == "payload" else _value(head, c) for c in self.columns])
                    size += 200 + len(body or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held), schema)], schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)

    def write(self, iterator):
        system, root = _open(self.path)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size = system.open_output_stream(f"{root}/{name}", compression=None), 0
                member = gzip_member(record_bytes(row, self.date))
                out.write(member)
                size += len(member)
                if size > FILE_BYTES:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return _Written(files)

    def commit(self, messages):
        system, root = _open(self.path)
        with system.open_output_stream(f"{root}/{LIST}") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())

    def abort(self, messages):
        system, root = _open(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                system.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of a file or folder; without the payload column no payload is decoded."""
    register(spark)
    schema = SCHEMA if payload else SCHEMA.rpartition(", ")[0]
    return spark.read.format("warc").schema(schema).load(path)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> None:
    """Write one record per row: a response with the html as payload, or a revisit of an equal one.

    Of equal payloads of at least ``least`` bytes the largest id is the response (rows that
    repeat that id all are), the others revisit it; smaller payloads and rows with a null
    id are always responses.  Null html is an empty payload.  Equal payloads meet by SHA-1
    and length in an aggregate of digests; texts aren't shuffled unless the table of
    repeated payloads is too large to broadcast.
    """
    from marrow.llm.common import checkpointed, small_side

    register(pages.sparkSession)
    html = F.encode(F.coalesce(pages[html_col], F.lit("")), "UTF-8")
    src = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), html.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    equal = src.where((F.col("size") >= least) & F.col("id").isNotNull()).groupBy("digest", "size").agg(F.max("id").alias("origin"), F.count("*").alias("n")).where("n > 1")
    equal = small_side(checkpointed(equal.select(F.col("digest").alias("d"), F.col("size").alias("s"), "origin")))
    met = src.join(equal, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    again = F.coalesce(F.col("origin") != F.col("id"), F.lit(False))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    rows = met.select(
        urn(F.col("id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(None).cast("string").alias("date"),
        F.col("digest").alias("payload_digest"),
        F.col("size").alias("payload_length"),
        F.when(again, urn(F.col("origin"))).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    rows.write.format("warc").mode("append").save(path)


def page_of(urn):
    """The id in a record id that archive() wrote; null for a null id."""
    return F.expr(f"try_cast(substring({urn}, length('urn:page:') + 1) as bigint)")

"""WARC archives as a PySpark data source, and deduplicating page archives.

Records are written one gzip member each. A member names its own packed length
in the gzip header (extra field ``LX``), so a reader that needs only the header
block, or not even that record, inflates a few hundred bytes and seeks on.
Members without that field, as other tools write them, are read through.

A folder written here has a manifest of committed files; files of lost or
speculative attempts are never in it. Folders and files without manifest are
listed instead.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

SCHEMA = (
    "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, "
    "payload_bytes bigint, headers map<string,string>, payload binary"
)
#: Column of the table -> WARC header that holds it.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
MANIFEST = "_manifest.json"
MIN_REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _line(value) -> str:
    """A header value: line breaks and other controls are percent-encoded."""
    return "".join(quote(c) if ord(c) < 32 or ord(c) == 127 else c for c in str(value))


def _member(record: bytes, level: int) -> bytes:
    """One gzip member whose extra field ``LX`` is the length of the whole member."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    extra = b"LX" + struct.pack("<HQ", 8, 10 + 2 + 12 + len(body) + 8)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def record(kind: str, record_id: str, uri, digest: str, refers_to, payload: bytes, payload_bytes: int) -> bytes:
    """One WARC/1.1 record with an HTTP response block; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n"
    block = http.encode() + (payload if kind != "revisit" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_line(record_id)}>"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_line(uri)}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_line(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + _END + block + _END


def _clean(name: str, value: str) -> str:
    if name in ("WARC-Record-ID", "WARC-Refers-To") and value[:1] == "<" and value[-1:] == ">":
        return value[1:-1]
    if name == "WARC-Payload-Digest" and value.startswith("sha1:"):
        return value[5:]
    return value


class _Members:
    """Walks the gzip members of one file; ``head`` inflates up to the end of the WARC header."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.start = handle, size, 0

    def __iter__(self):
        while self.start < self.size:
            self.handle.seek(self.start)
            self.raw = self.handle.read(4096)
            if self.raw[:3] != b"\x1f\x8b\x08":
                raise ValueError(f"no gzip member at byte {self.start}")
            flags, at = self.raw[3], 10
            self.length = None
            if flags & 4:
                (n,) = struct.unpack_from("<H", self.raw, at)
                extra, at = self.raw[at + 2 : at + 2 + n], at + 2 + n
                if extra[:2] == b"LX" and len(extra) == 12:
                    (self.length,) = struct.unpack_from("<Q", extra, 4)
            for bit in (8, 16):
                if flags & bit:
                    at = self.raw.index(b"\0", at) + 1
            at += 2 if flags & 2 else 0
            self.z, self.fed, self.out = zlib.decompressobj(-15), self.raw[at:], b""
            yield self
            if self.length is None:
                self.rest()
                used = self.handle.tell() - len(self.z.unused_data)
                self.start = used + 8
            else:
                self.start += self.length

    def _more(self, most: int) -> bool:
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.fed or self.handle.read(1 << 16)
        self.fed = b""
        if not data:
            raise ValueError("a record is cut off")
        self.out += self.z.decompress(data, most)
        return True

    def head(self) -> dict[str, str]:
        while (end := self.out.find(_END)) < 0 and self._more(1024):
            pass
        lines = self.out[:end].decode("utf-8", "replace").split("\r\n")[1:]
        self.body = end + 4
        pairs = (x.partition(":") for x in lines)
        return {k.strip(): _clean(k.strip(), v.strip()) for k, _, v in pairs}

    def rest(self) -> bytes:
        parts = [self.out]
        while not self.z.eof:
            self.out = b""
            self._more(1 << 20)
            parts.append(self.out)
        self.out = b"".join(parts)
        return self.out

    def http_head(self) -> bytes:
        while (end := self.out.find(_END, self.body)) < 0 and self._more(1024):
            pass
        return self.out[self.body : end] if end >= 0 else b""


def _http_length(head: bytes):
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder or file)``.

    Options: ``payload`` (default true) whether bodies are decoded at all.
    Equality and membership tests on the columns of ``HEADERS`` are decided from
    the header block, before any body is inflated.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


class _File(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = (f.value,) if isinstance(f, EqualTo) else tuple(f.value)
                self.wanted.append((HEADERS[f.attribute[0]], values))
            else:
                yield f

    def partitions(self):
        system, path = _at(self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            return [_File(self.path, system.get_file_info(path).size)]
        names = None
        if system.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{path}/{MANIFEST}") as f:
                names = json.loads(f.read())
        found = system.get_file_info(fs.FileSelector(path))
        return [
            _File(f"{self.path}/{x.base_name}", x.size)
            for x in sorted(found, key=lambda x: x.base_name)
            if x.type == fs.FileType.File
            and x.base_name.endswith(".warc.gz")
            and (names is None or x.base_name in names)
        ]

    def read(self, partition):
        if partition is None:  # an archive of no files
            return
        system, path = _at(partition.path)
        rows, held = [], 0
        with system.open_input_file(path) as handle:
            for member in _Members(handle, partition.size):
                head = member.head()
                if any(head.get(name) not in values for name, values in self.wanted):
                    continue
                length = _http_length(member.http_head())
                body = None
                if self.payload and head.get("WARC-Type") != "revisit":
                    body = member.rest()[member.body : -4]
                    if head.get("Content-Type", "").startswith("application/http"):
                        body = body.partition(_END)[2]
                    length = len(body)
                rows.append([*(head.get(h) for h in HEADERS.values()), length, list(head.items()), body])
                held += len(body or b"") + 500
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema(
    [(c, pa.string()) for c in HEADERS]
    + [("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW
    )


class _Written(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Needs the columns of ``HEADERS``, ``payload_bytes`` and ``payload``; others are ignored."""

    def __init__(self, options):
        self.path = options["path"]
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))
        self.level = int(options.get("level", 6))

    def write(self, iterator):
        system, path = _at(self.path)
        system.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(c) for c in (*HEADERS, "payload_bytes", "payload")]
            for i in range(batch.num_rows):
                kind, rid, uri, digest, refers, length, body = (c[i].as_py() for c in columns)
                data = _member(record(kind, rid, uri, digest, refers, body or b"", length), self.level)
                if out is None or size + len(data) > self.file_bytes:
                    if out:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return _Written(names)

    def commit(self, messages):
        system, path = _at(self.path)
        system.create_dir(path, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.names)
        with system.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        system, path = _at(self.path)
        for n in (n for m in messages if m is not None for n in m.names):
            system.delete_file(f"{path}/{n}")


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of an archive folder or file; filters on header columns reach the reader."""
    _register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(records: DataFrame, path: str) -> None:
    """Write records that have the columns of ``SCHEMA`` to a new folder ``path``."""
    _register(records.sparkSession)
    records.select(*HEADERS, "payload_bytes", "payload").write.format("warc").mode("append").save(path)


def page_records(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", smallest: int = MIN_REVISIT_BYTES
) -> DataFrame:
    """A WARC record per page; of equal payloads the largest key is the response.

    NULL html is an empty payload, a NULL url leaves the URI header out. Payloads
    below ``smallest`` bytes are always responses, and so are NULL keys and rows
    that repeat the largest key. A record's id is ``urn:page:<key>``. Only digests
    of payloads that occur twice are joined back, and a hot digest's partition
    can be split, as one side of that join is unique.
    """
    rows = pages.select(
        F.col(key).alias("_key"), F.col(url).alias("target_uri"), F.coalesce(html, F.lit("")).cast("binary").alias("payload")
    ).withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("bigint")})
    owners = (
        rows.where(F.col("payload_bytes") >= smallest)
        .groupBy("payload_digest")
        .agg(F.max("_key").alias("_owner"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    revisits = (F.col("payload_bytes") >= smallest) & (F.col("_key") < F.col("_owner"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return (
        rows.join(owners, "payload_digest", "left")
        .withColumn("record_type", F.when(revisits, "revisit").otherwise("response"))
        .select(
            "record_type",
            urn("_key").alias("record_id"),
            "target_uri",
            "payload_digest",
            F.when(revisits, urn("_owner")).alias("refers_to"),
            "payload_bytes",
            F.when(~F.coalesce(revisits, F.lit(False)), F.col("payload")).alias("payload"),
        )
    )


def page_report(spark: SparkSession, path: str) -> DataFrame:
    """What an archive of ``page_records`` says of each page, read back.

    Responses are decoded and their digest and length taken from the bytes;
    revisits are answered from their header blocks alone.
    """
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    responses = read_warc(spark, path).where(F.col("record_type") == "response")
    revisits = read_warc(spark, path, payload=False).where(F.col("record_type") == "revisit")
    columns = ["record_type", "record_id", "refers_to", "payload_bytes", "payload_digest"]
    return (
        responses.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload")})
        .select(*columns)
        .unionByName(revisits.select(*columns))
        .select(
            number("record_id").alias("page_id"),
            F.col("payload_bytes").cast("bigint").alias("payload_bytes"),
            "payload_digest",
            "record_type",
            number("refers_to").alias("refers_to"),
        )
    )

"""WARC archives: a writer that records repeated payloads as revisits, and a PySpark data source ``warc`` that reads them.

Each record is a gzip member of its own whose header carries the member's length (extra field ``sl``), as the WARC
standard's annex on compression describes, so a reader can step over a record without decoding it. The data source plans
file partitions on the driver, takes record-type and header equality predicates from Spark, decodes a record's headers
first, and inflates its payload only if the record passes and payloads are asked for. Archives without ``sl`` fields are
read by inflating and discarding.

A reader goes from record to record, from a known start. Bytes inside a payload may look like a record (a page about
archives, an archive in an archive), so none is ever searched for: the writer lists where records start, one every
``MARK_BYTES``, beside each archive (``.idx``), and a large archive is cut at such places only. One without a list is
one partition.

Options: ``path`` (a file, folder or comma-separated list), ``payload`` (true: decode payloads and verify their digests),
``split`` (bytes of a partition). Fields of the http header block are only looked at for the media type and the length of
a revisited payload; a block without a blank line is all header, with an empty payload. A record without a digest gets
that of its payload where payloads are decoded; predicates on digests are checked again by Spark, so they see it.

Writer: of the rows with equal payloads of at least ``least`` bytes, those with the largest key are responses and others
revisit it. Payloads meet by digest; the largest key of a digest is a partial aggregate, and the join back can be split
where a payload is common. Defined results: a null html is an empty payload; rows with a null key are always responses
and never revisited; rows that repeat the largest key are all responses; extra columns are ignored; an empty table
writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tidewater.llm.common import filesystem, normal_uri, shared_path, slices

FILE_BYTES, MARK_BYTES = 256 << 20, 4 << 20
SCHEMA = (
    "record_id string, record_type string, target_uri string, warc_date string, content_type string, "
    "payload_bytes long, payload_digest string, refers_to string, payload binary"
)
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Header names and the revisit profile of the WARC 1.1 standard.
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: Suffix of the list of record starts (u64 each, little-endian) beside an archive.
INDEX = ".idx"
_FEXTRA = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def member(record: bytes) -> bytes:
    """The record as a gzip member that tells its own compressed and plain length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = len(_FEXTRA) + 2 + 4 + 8 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    return _FEXTRA + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(record_id: str, kind: str, uri: str | None, payload: bytes | None, size: int, sha1: str, refers_to: str | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit with the http header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}"]
    if uri:
        head.append("WARC-Target-URI: " + "".join(c if c not in "\r\n" else f"%{ord(c):02X}" for c in uri))
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str | None = None, key: str = "page_id", uri: str = "url", html: str = "html", least: int = 0, prefix: str = "urn:page:", mark: int = MARK_BYTES) -> list[str]:
    """Writes a record for every row; returns the archives. Only files listed are part of the archive, so failed or repeated attempts do no harm."""
    spark = pages.sparkSession
    path = normal_uri(path or shared_path(spark, "warc"))
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{uri}`").alias("u"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("h"))
    rows = rows.withColumn("d", F.sha1(F.col("h").cast("binary")))
    # the join key is another spelling of the digest: both sides are dealt anew and Spark can split a common one
    heads = rows.groupBy("d").agg(F.max("k").alias("head")).select(F.unhex("d").alias("d1"), "head")
    joined = rows.withColumn("d1", F.unhex("d")).join(heads, "d1")
    revisits = (F.octet_length("h") >= least) & F.coalesce(F.col("k") < F.col("head"), F.lit(False))
    size = F.octet_length("h").cast("long").alias("n")
    records = joined.select("k", "u", F.when(~revisits, F.col("h")).alias("h"), size, F.col("d1").alias("d"), F.when(revisits, F.col("head")).alias("head"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, fs, out, listed, written, marks = TaskContext.get(), None, None, [], 0, [0]

        def close() -> None:
            out.close()
            if len(marks) > 1:
                with fs.open_output_stream(f"{folder}/{name}{INDEX}", compression=None) as f:
                    f.write(struct.pack(f"<{len(marks)}Q", *marks))

        for batch in slices(batches, "h"):
            for k, u, h, n, d, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, folder = filesystem(path)
                    fs.create_dir(folder, recursive=True)
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(listed):04d}.warc.gz"
                    listed.append(f"{path}/{name}")
                    out, written, marks = fs.open_output_stream(f"{folder}/{name}", compression=None), 0, [0]
                number = f"{prefix}{'' if k is None else k}"
                kind = "response" if head is None else "revisit"
                packed = member(record(number, kind, u, (h or "").encode("utf-8", "surrogatepass"), n, base64.b32encode(d).decode(), f"{prefix}{head}"))
                if written - marks[-1] >= mark:
                    marks.append(written)
                out.write(packed)
                written += len(packed)
                if written > FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if listed:
            yield pa.RecordBatch.from_pydict({"file": listed})

    return sorted(r["file"] for r in records.mapInArrow(write, "file string").collect())


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.payload = options.get("payload", "false").lower() == "true"
        self.split = int(options.get("split", 64 << 20))
        self.paths = [normal_uri(p) for p in options.get("path", "").split(",") if p]
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and membership of header fields; Spark keeps the others, and digests, which a header may lack."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else {*f.value}
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
                if name == "payload_digest":
                    yield f
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        out = []
        for path in self.paths:
            fs, place = filesystem(path)
            info = fs.get_file_info(place)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            files = [info] if info.type == pafs.FileType.File else sorted((x for x in fs.get_file_info(pafs.FileSelector(place, recursive=True)) if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))), key=lambda x: x.path)
            for x in files:
                file = path if info.type == pafs.FileType.File else path.rstrip("/") + x.path[len(place.rstrip("/")) :]
                edges = [0]
                if x.size > self.split and fs.get_file_info(x.path + INDEX).is_file:
                    with fs.open_input_stream(x.path + INDEX, compression=None) as f:
                        raw = f.read()
                    for (start,) in struct.iter_unpack("<Q", raw):
                        if start - edges[-1] >= self.split:
                            edges.append(start)
                out += [_Range(file, a, b) for a, b in zip(edges, [*edges[1:], x.size], strict=True)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in read_records(partition.file, partition.start, partition.end, self.wanted, self.payload):
            rows.append(row)
            size += len(row[-1] or b"")
            if len(rows) >= 5000 or size > 8 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


class _Stream:
    """Decoded bytes of the record that starts at ``at``, plain or in a gzip member, read piece by piece."""

    def __init__(self, f, at: int, size: int):
        f.seek(at)
        self.f, self.at, self.size = f, at, size
        head = f.read(min(size - at, 24))
        self.packed = head[:2] == b"\x1f\x8b"
        self.length = None  # of the member, where its header tells
        if self.packed and len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
            self.length = struct.unpack_from("<I", head, 16)[0]
        self.inflate = zlib.decompressobj(31) if self.packed else None
        f.seek(at)
        self.taken, self.buffer = 0, b""

    def more(self, n: int = 1 << 14) -> bool:
        raw = self.inflate.unconsumed_tail if self.packed else b""
        if not raw:
            if self.packed and self.inflate.eof or self.at + self.taken >= self.size:
                return False
            raw = self.f.read(min(n, self.size - self.at - self.taken, *([self.length - self.taken] if self.length else [])))
            self.taken += len(raw)
        if not raw:
            return False
        self.buffer += self.inflate.decompress(raw, 1 << 20) if self.packed else raw
        return True

    def until(self, mark: bytes, most: int | None = None) -> bytes | None:
        """What is before the mark; None if it is not within the next ``most`` bytes, which then stay."""
        while (k := self.buffer.find(mark, 0, most)) < 0:
            if most is not None and len(self.buffer) >= most or not self.more():
                return None
        out, self.buffer = self.buffer[:k], self.buffer[k + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self.more(max(1 << 14, min(n - have, 1 << 20))):
                raise ValueError("a record ends early")
            parts.append(self.buffer)
            have += len(self.buffer)
        whole = b"".join(parts)
        self.buffer = whole[n:]
        return whole[:n]

    def end(self, rest: int) -> int:
        """Where the next record starts, ``rest`` decoded bytes further on; a member that tells its length is not inflated."""
        if self.length:
            return self.at + self.length
        if not self.packed:
            return self.at + self.taken - len(self.buffer) + rest
        self.buffer = b""
        while self.more():
            self.buffer = b""
        return self.at + self.taken - len(self.inflate.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else value


def read_records(file: str, start: int, end: int, wanted: dict[str, set] | None = None, payloads: bool = False) -> Iterator[tuple]:
    """The rows of SCHEMA of the records that start in [start, end). Payloads of unwanted records are never decoded."""
    fs, place = filesystem(file)
    wanted = {HEADERS[k].lower(): v for k, v in (wanted or {}).items()}
    with fs.open_input_file(place) as f:
        size = f.size()
        at = start
        while at < min(end, size):
            stream = _Stream(f, at, size)
            head = stream.until(b"\r\n\r\n")
            if head is None or not head.startswith(b"WARC/"):
                raise ValueError(f"no record at byte {at} of {file}")
            fields = _fields(head)
            block = int(fields["content-length"])
            sha1 = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            shown = fields | {k: _bare(fields.get(k)) for k in ("warc-record-id", "warc-refers-to")} | {"warc-payload-digest": sha1}
            if any(shown.get(k) not in v for k, v in wanted.items() if k != "warc-payload-digest" or sha1):
                at = stream.end(block + 4)
                continue
            kind, length, media, body, used = fields.get("warc-type"), block, fields.get("content-type"), None, 0
            if (media or "").startswith("application/http") and block:
                http = stream.until(b"\r\n\r\n", block)
                used = block if http is None else len(http) + 4
                own = _fields(stream.take(block) if http is None else http)
                told = own.get("content-length", "")
                length, media = int(told) if kind == "revisit" and told.isdecimal() else block - used, own.get("content-type")
            if payloads and kind != "revisit":
                body = stream.take(block - used)
                used = block
                length = len(body)
                if sha1 and digest(body) != sha1:
                    raise ValueError(f"the payload at byte {at} of {file} does not have its digest")
                sha1 = sha1 or digest(body)
            yield (shown.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), media, length, sha1, shown.get("warc-refers-to"), body)
            at = stream.end(block - used + 4)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``, after register(spark)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Registers the data source and lets Spark hand predicates to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, files: list[str], payload: bool = False) -> DataFrame:
    register(spark)
    if not files:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(",".join(files))

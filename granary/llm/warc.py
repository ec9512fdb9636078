"""WARC archives as a data source: format("warc") reads and writes them.

Reading plans one partition per archive file. A record's header block is parsed first; record types, header
equality, prefixes and the like are judged on it, from filters that Spark pushes down, and the payload of a
record that fails is passed over: by a seek in plain files, and in compressed ones whose members tell their length in the
extra field "sl", as those written here do; other members are inflated piece by piece and dropped. With the option
payload=false no payload is decoded at all; with payload=check each is decoded and its length and digest are told, but it
is not handed on. Where a payload was decoded, payload_bytes and payload_digest are its own, else those of the headers.

What cannot be read, a header block without a proper Content-Length or a broken or cut off file, ends that file with one row of
the type "malformed", whose headers tell the file and the error; records before it are read.

Writing deals the rows of each task into files of their own, named after the task attempt. The commit renames
those of the attempts that succeeded and removes the rest, so lost executors leave nothing half written.

Any file system that pyarrow can open by its URI will do. Nulls: a null payload is an empty one, a null id,
address or reference leaves its header out, and a header that a record lacks reads as null.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from granary.llm.common import Scratch, broadcast_if_small

#: Names that the format prescribes.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, page_id long, headers map<string,string>, payload binary"

#: Columns that are a header each; filters on them are judged before the payload is read.
HEADER_OF = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
}

FILE_BYTES = 1 << 30
CHUNK = 1 << 20
HEAD_BYTES = 1 << 24
BATCH_BYTES = 8 << 20


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_urn(page_id: int) -> str:
    """A version 8 UUID that holds the id, so that references need no join."""
    n = page_id & (1 << 64) - 1
    return uuid.UUID(int=(n >> 32) << 80 | 8 << 76 | 2 << 62 | n & 0xFFFFFFFF).urn


def page_of(urn: str | None) -> int | None:
    try:
        n = uuid.UUID((urn or "").strip("<>")).int
    except ValueError:
        return None
    if n >> 76 & 15 != 8 or n >> 62 & 3 != 2:
        return None
    value = (n >> 80 & 0xFFFFFFFF) << 32 | n & 0xFFFFFFFF
    return value - (1 << 64) if value >> 63 else value


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def build_record(page_id: int | None, uri: str | None, payload: bytes, date: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    urn = record_urn(page_id) if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, f"{uri}#{base32_sha1(payload)}").urn
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_line(uri)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: <{record_urn(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"Content-Type: {HTTP_TYPE}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.gzip, self.overwrite = options["path"].rstrip("/"), options.get("compression", "gzip") == "gzip", overwrite
        self.date, self.file_bytes = options.get("date", "2000-01-01T00:00:00Z"), int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        store.create_dir(f"{root}/_temporary", recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(k).to_pylist() for k in map(batch.schema.get_field_index, ("page_id", "url", "payload", "refers_to"))]
            for page_id, uri, payload, refers_to in zip(*columns, strict=True):
                if out is None or size >= self.file_bytes:
                    if out:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out, size = store.open_output_stream(f"{root}/_temporary/{files[-1]}", compression=None), 0
                record = build_record(page_id, uri, payload or b"", self.date, refers_to)
                if self.gzip:
                    record = pack_member(record)
                out.write(record)
                size += len(record)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = filesystem(self.path)
        done = [f for m in messages if m for f in m.files]
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.base_name.startswith("part-"):
                    store.delete_file(old.path)
        for name in done:
            store.move(f"{root}/_temporary/{name}", f"{root}/{name}")
        if store.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_temporary")

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, root = filesystem(self.path)
        if store.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_temporary")


@dataclass
class Archive(InputPartition):
    path: str


def _judge(f, headers: dict[str, str]) -> bool:
    """A pushed filter on the headers of a record; Spark's rule that null is not true."""
    if isinstance(f, Not):
        child = f.child
        return headers.get(HEADER_OF[child.attribute[0]]) is not None and not _judge(child, headers)
    found = headers.get(HEADER_OF[f.attribute[0]])
    if isinstance(f, IsNotNull):
        return found is not None
    if found is None:
        return False
    if isinstance(f, (EqualTo, EqualNullSafe)):
        return found == f.value
    if isinstance(f, In):
        return found in f.value
    if isinstance(f, StringStartsWith):
        return found.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return found.endswith(f.value)
    return f.value in found


def _can_judge(f) -> bool:
    if isinstance(f, Not):
        return isinstance(f.child, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and _can_judge(f.child)
    known = isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains))
    return known and len(f.attribute) == 1 and f.attribute[0] in HEADER_OF and not (isinstance(f, EqualNullSafe) and f.value is None)


class Bytes:
    """A file's content, unpacked if it is compressed, a bounded piece at a time, with skip() that seeks where it can."""

    def __init__(self, file, gzip: bool):
        self.file, self.gzip, self.buffer, self.ended = file, gzip, bytearray(), False
        # Of the compressed input: what is read ahead and where it stands; of the open member: its unpacker, end, length, and what it gave.
        self.raw, self.offset, self.unpack, self.end, self.length, self.given = b"", 0, None, None, 0, 0

    def _ahead(self, n: int) -> bool:
        while len(self.raw) < n:
            data = self.file.read(CHUNK)
            if not data:
                break
            self.raw += data
        return bool(self.raw)

    def _open_member(self) -> None:
        self.unpack, self.end, self.length, self.given = zlib.decompressobj(31), None, 0, 0
        if self.raw[3:4] == b"\x04" and self.raw[12:16] == b"sl\x08\0":
            size, self.length = struct.unpack("<II", self.raw[16:24])
            self.end = self.offset + size

    def fill(self) -> bool:
        if self.ended:
            return False
        if not self.gzip:
            data = self.file.read(CHUNK)
            self.ended = not data
            self.buffer += data
            return bool(data)
        if not self._ahead(24 if self.unpack is None else 1):
            if self.unpack is not None:
                raise EOFError("cut off inside a record")
            self.ended = True
            return False
        if self.unpack is None:
            self._open_member()
        data, before = self.unpack.decompress(self.raw, 4 * CHUNK), len(self.raw)
        self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
        self.offset += before - len(self.raw)
        self.buffer += data
        self.given += len(data)
        if self.unpack.eof:
            self.unpack = None
        return True

    def head(self) -> bytes | None:
        """Up to the empty line that ends a header block, without it; None at the end."""
        start = 0
        while True:
            if (at := self.buffer.find(b"\r\n\r\n", start)) >= 0:
                out = bytes(self.buffer[:at])
                del self.buffer[: at + 4]
                return out
            start = max(0, len(self.buffer) - 3)
            if start > HEAD_BYTES:
                raise ValueError("a header block without an end")
            if not self.fill():
                if self.buffer.strip():
                    raise EOFError("cut off inside a header block")
                return None

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.fill():
                raise EOFError("cut off inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def skip(self, n: int) -> None:
        while n > 0:
            have = min(n, len(self.buffer))
            del self.buffer[:have]
            n -= have
            if n and not self.gzip:
                self.file.seek(self.file.tell() + n)
                return
            if n and self.unpack is not None and self.end is not None and n >= self.length - self.given:
                n -= self.length - self.given
                ahead = self.end - self.offset
                if ahead > len(self.raw):
                    self.file.seek(self.end)
                self.raw, self.offset, self.unpack = self.raw[ahead:], self.end, None
            elif n and not self.fill():
                return


def pack_member(record: bytes) -> bytes:
    """A gzip member that tells its own and its content's length in the extra field "sl"."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 24 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    if max(size, len(record)) >> 32:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record)) + body + tail


def _fields(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.filters = options["path"].rstrip("/"), options.get("payload", "true").lower(), []
        if self.payload not in ("true", "false", "check"):
            raise ValueError("payload is true, false or check")

    def pushFilters(self, filters):
        for f in filters:
            if _can_judge(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        store, root = filesystem(self.path)
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
        found = sorted(f.path for f in files if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")))
        return [Archive(p) for p in found] or [Archive("")]

    def read(self, partition: Archive):
        if not partition.path:
            return
        store, _ = filesystem(self.path)
        with store.open_input_file(partition.path) as file:
            data = Bytes(file, partition.path.endswith(".gz"))
            try:
                while (head := data.head()) is not None:
                    headers = _fields(head.lstrip(b"\r\n"))
                    length = _length(headers)
                    if not all(_judge(f, headers) for f in self.filters):
                        data.skip(length + 4)
                        continue
                    yield self.row(headers, length, data)
                    data.skip(4)
            except (ValueError, EOFError, zlib.error) as error:
                told = {"warc-type": "malformed", "file": partition.path, "error": str(error)}
                if all(_judge(f, told) for f in self.filters):
                    yield (None, "malformed", None, None, None, None, None, None, told, None)

    def row(self, headers: dict[str, str], length: int, data: Bytes):
        left, size, payload = length, length, None
        digest = (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        if headers.get("content-type", "").startswith("application/http"):
            before = data.head() or b""
            left -= len(before) + 4
            size = _length(_fields(before), left)
        if self.payload != "false" and headers.get("warc-type") != "revisit":
            payload = data.take(left)
            size, digest = len(payload), base32_sha1(payload)
        else:
            data.skip(left)
        page_id = page_of(headers.get("warc-record-id"))
        return (headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"), headers.get("warc-date"), digest, size, headers.get("warc-refers-to"), page_id, headers, payload if self.payload == "true" else None)


def _length(headers: dict[str, str], default: int | None = None) -> int:
    value = headers.get("content-length", default)
    if value is None or not str(value).isdecimal():
        raise ValueError(f"not a Content-Length: {value}")
    return int(value)


ARROW = pa.schema(
    [(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "date", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("page_id", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


class BatchReader(WarcReader):
    """The records as record batches of some megabytes."""

    def read(self, partition: Archive):
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            columns[8] = [list(h.items()) for h in columns[8]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

        for row in super().read(partition):
            rows.append(row)
            size += 1000 + len(row[9] or b"")
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(folder); df.write.format("warc") takes page_id, url, payload, refers_to."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return BatchReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def mark_revisits(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, salts: int = 16, small: int = 500_000) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the smallest id with an equal payload, null for that one itself.

    Only payloads that occur twice or more enter the join, as a digest and an id each. Up to `small` of them are
    broadcast; more are joined over salted digests, as one payload may be a third of all rows. Rows that share
    the smallest id are all responses; a row without an id refers to the smallest id that there is, or is a response.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha"), F.octet_length(html).alias("n"))
    firsts = rows.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("sha", "first")
    firsts = Scratch(spark).table(firsts, "firsts")
    chosen = broadcast_if_small(firsts, small)
    if chosen is firsts:
        firsts = firsts.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(firsts, ["sha", "salt"], "left")
    else:
        joined = rows.join(chosen, "sha", "left")
    refers = F.when((F.col("n") >= min_bytes) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return joined.select("page_id", "url", F.encode("html", "UTF-8").alias("payload"), refers.alias("refers_to"))


def write_warc(rows: DataFrame, path: str, **options: str) -> None:
    register(rows.sparkSession)
    rows.select("page_id", "url", "payload", F.col("refers_to").cast("long").alias("refers_to")).write.format("warc").options(**options).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def referred_page(urn):
    """The id in a reference, from its hexadecimal digits, by built-in functions."""
    digits = F.regexp_replace(urn, "^<urn:uuid:|-|>$", "")
    number = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("long")
    return F.when(urn.isNotNull(), F.shiftleft(number(5), 32).bitwiseOR(number(25)))


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes a record per row of pages into the shared folder and reads the archives back, each payload decoded and digested."""
    path = Scratch(spark).path("archive")
    write_warc(mark_revisits(spark, pages, min_bytes), path)
    back = read_warc(spark, path, payload="check").where(F.col("record_type").isin("response", "revisit"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", referred_page(F.col("refers_to")).alias("refers_to"))

"""WARC archives: a writer of deduplicated records and a Python data source that reads them.

Records are gzip members of their own, whose header carries the member's
length, so a reader gets from record to record without inflating what it does
not want. The data source plans byte ranges of files as partitions, takes
equality filters on the record type and on header columns, parses a record's
headers first and inflates the payload only of records that passed, and only
if payloads are asked for (option `payload`). Archives of other writers
(members without a length, or uncompressed files) are read too.

Writing needs no order: equal payloads find their response by one sum per
digest. Files are renamed when whole, so a repeated task leaves one archive.

Defined cases: a null payload is empty; payloads under `least` bytes are never
revisits; of equal payloads, all rows with the largest id are responses; rows
without id are never the one that others refer to unless none has an id;
null uris are written without a target; very long payloads are one record; an
empty table writes no file and reads as no record; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SPLIT_BYTES = 64 << 20
_SKIP = struct.Struct("<4sIBBH2sHII")  # gzip head with the extra field: magic and flags, time, -, -, extra length, "sl", 8, member bytes, inflated bytes
_MAGIC = b"\x1f\x8b\x08"
_COLUMNS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in _COLUMNS) + ", headers map<string,string>, http_headers map<string,string>, payload binary, file string, offset long"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member whose header tells its length."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    size = _SKIP.size + len(body) + 8
    head = _SKIP.pack(_MAGIC + b"\x04", 0, 0, 255, 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    if kind == "response":
        block += payload or b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if uri is not None:
        head.append(("WARC-Target-URI", quote(uri, safe=":/?#[]@!$&'()*+,;=%-._~")))
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def deduplicated(pages: DataFrame, record_id: Column, least: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(record_type, record_id, target_uri, payload, digest, n_bytes, refers_to): a revisit for all but one of equal payloads."""
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"), record_id.alias("record_id"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    first = rows.filter(F.col("n_bytes") >= least).groupBy("digest").agg(
        F.max_by("record_id", "id").alias("target"), F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    both = rows.join(first.select("digest", "target", "first"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    return both.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "record_id", F.col("url").alias("target_uri"),
        F.when(~again, F.col("payload")).alias("payload"), "digest", "n_bytes", F.when(again, F.col("target")).alias("refers_to"))


def write(records: DataFrame, folder: str, level: int = 6) -> None:
    """One archive per task, below a folder that all executors reach."""
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = file_system(folder)
        name, part, out, n = f"records-{TaskContext.get().partitionId():06d}.warc.gz", f"{root}/.part-{uuid.uuid4().hex}", None, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("record_type", "record_id", "target_uri", "payload", "digest", "n_bytes", "refers_to")]
            for i in range(len(batch)):
                out = out or fs.open_output_stream(part)
                out.write(member(record(*(c[i].as_py() for c in columns)), level))
                n += 1
        if out:
            out.close()
            fs.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    records.mapInArrow(run, "n long").agg(F.sum("n")).collect()


class Range(InputPartition):
    """The records that begin in these bytes of a file."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Inflated:
    """The bytes of a gzip member, inflated as far as they are asked for."""

    def __init__(self, file: pa.NativeFile, offset: int):
        self.file, self.at, self.object, self.rest, self.buffer = file, offset, zlib.decompressobj(31), b"", bytearray()

    def ask(self, n: int) -> bytes:
        """The first n bytes, or all."""
        while len(self.buffer) < n and not self.object.eof:
            data = self.object.unconsumed_tail
            if not data:
                data = self.file.read_at(1 << 15, self.at)
                self.at += len(data)
                if not data:
                    break
            self.buffer += self.object.decompress(data, max(n - len(self.buffer), 1))
        return bytes(memoryview(self.buffer)[:n])

    def end(self) -> int:
        """Where the member ends; what is left is inflated and dropped."""
        while not self.object.eof:
            data = self.object.unconsumed_tail or self.file.read_at(1 << 15, self.at)
            if not self.object.unconsumed_tail:
                self.at += len(data)
            if not data:
                return self.at
            self.object.decompress(data, 1 << 20)
        return self.at - len(self.object.unused_data)


class _Plain:
    def __init__(self, file: pa.NativeFile, offset: int):
        self.file, self.offset = file, offset

    def ask(self, n: int) -> bytes:
        return self.file.read_at(n, self.offset)


def parse_head(read, prefix: int = 0) -> tuple[dict[str, str], int]:
    """Header lines from `prefix` on up to the empty line: ({lower-case name: value}, where the block begins)."""
    size = 2048
    while True:
        data = read(prefix + size)
        end = data.find(b"\r\n\r\n", prefix)
        if end >= 0 or len(data) < prefix + size:
            break
        size *= 4
    if end < 0:
        return {}, len(data)
    lines = data[prefix:end].decode("utf-8", "replace").split("\r\n")
    pairs = (x.split(":", 1) for x in lines[1:] if ":" in x)
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, v in pairs}, end + 4


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _COLUMNS:
                self.wanted.append((f.attribute[0], (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.is_file else fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
        out: list[InputPartition] = []
        for f in sorted((f for f in files if f.is_file and f.path.endswith((".warc", ".warc.gz")) and not f.base_name.startswith(".")), key=lambda f: f.path):
            step = self.split if f.path.endswith(".gz") else max(f.size, 1)
            out += [Range(f.path, a, min(a + step, f.size)) for a in range(0, f.size, step)]
        return out or [Range("", 0, 0)]

    def _first(self, file: pa.NativeFile, start: int, size: int) -> int:
        """The first member at or after start."""
        at = start
        while start and at < size:
            data = file.read_at(1 << 16, at)
            hit = data.find(_MAGIC)
            if hit < 0:
                at += max(len(data) - 2, 1)
                continue
            try:
                if _Inflated(file, at + hit).ask(5) == b"WARC/":
                    return at + hit
            except zlib.error:
                pass
            at += hit + 1
        return at

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = file_system(self.path)
        file = fs.open_input_file(partition.path)
        size, zipped = file.size(), partition.path.endswith(".gz")
        at = self._first(file, partition.start, size) if zipped else partition.start
        rows: list[tuple] = []
        held = 0
        while at < min(partition.end, size):
            begin = at
            source = _Inflated(file, at) if zipped else _Plain(file, at)
            head, block = parse_head(source.ask)
            if not head.get("", "").startswith("WARC/"):
                raise ValueError(f"no WARC record at {partition.path}:{at}")
            length = int(head.get("content-length", 0))
            values = {c: head.get(h.lower()) for c, h in _COLUMNS.items()}
            good = all(values[c] in wanted for c, wanted in self.wanted)
            http, payload = {}, None
            if good:
                body = block
                if (values["content_type"] or "").startswith("application/http"):
                    http, body = parse_head(source.ask, block)
                if self.payload:
                    payload = source.ask(block + length)[body:]
                    held += len(payload)
                plain = lambda d: [(k, v) for k, v in d.items() if k]
                rows.append((*values.values(), plain(head), plain(http), payload, partition.path, begin))
            if not zipped:
                at = block + length + 4 + begin
            else:
                skip = file.read_at(_SKIP.size, begin)
                known = len(skip) == _SKIP.size and skip[3] & 4 and _SKIP.unpack(skip)[5] == b"sl" and _SKIP.unpack(skip)[8] < 1 << 31
                at = begin + _SKIP.unpack(skip)[7] if known else source.end()
            if len(rows) >= 2000 or held > 8 << 20:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text = pa.string()
    kinds = [text] * len(_COLUMNS) + [pa.map_(text, text), pa.map_(text, text), pa.binary(), text, pa.int64()]
    names = [*_COLUMNS, "headers", "http_headers", "payload", "file", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class WarcSource(DataSource):
    """format("warc"): path, payload (true), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The archive's records. Turns filter push-down to Python sources on for the session, which this source needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)

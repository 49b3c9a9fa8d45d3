"""WARC archives: writing pages with revisit records, and a data source that reads them.

Each record is one gzip member whose extra field "sl" holds the member's packed and plain length, so a reader
skips a record without unpacking it; members without the field are unpacked to find their end. The data
source plans partitions by file size, tests pushed predicates on type and headers right after the head of a record,
and unpacks the rest only of records that pass and whose payload is wanted.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from riskloom.llm import blocks, store

FILE_BYTES = 32 << 20
LEAST = 100  # bytes of payload from which equal payloads are stored once
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(record: bytes) -> bytes:
    """A gzip member with its packed and plain length in the extra field."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    total = 24 + len(body) + 8
    return struct.pack("<4BIBBH2sHII", 31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, total, len(record)) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(page, url: str | None, payload: bytes, size: int, digest: str, first) -> bytes:
    """One WARC record; a revisit of ``first``, without the payload, if that is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
            f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Archive every page; returns one row (file, records) per file.

    Of pages with equal payloads of at least ``least`` bytes, that with the smallest id is a response and larger
    ids revisit it. Repeated rows of the smallest id, and pages without an id, all stay responses. Null html
    is an empty payload, a null url leaves its header out. Other columns are not written.
    """
    source = pages.select(F.col(f"`{page}`").cast("long").alias("page"), F.col(f"`{url}`").alias("url"), F.coalesce(f"`{html}`", F.lit("")).alias("html"))
    source = source.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    keys = source.where(F.col("size") >= least).select("page", "digest")
    firsts = keys.groupBy("digest").agg(F.min("page").alias("first"), F.max("page").alias("_last")).where("first < _last").drop("_last")
    again = keys.join(firsts, "digest").where("page > first").distinct()
    marked = source.join(again.withColumnsRenamed({"page": "_page", "digest": "_digest"}), (F.col("page") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")

    def run(batches):
        held, count, made, size = [], 0, 0, 0

        def flush():
            name = f"part-{TaskContext.get().partitionId():06d}-{made:04d}.warc.gz"
            store.put(folder, name, held)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], names=["file", "records"])

        for part in blocks.slices(batches, "html"):
            raw = part.column("html").cast(pa.binary()).to_pylist()
            for row, payload in zip(part.drop_columns(["html"]).to_pylist(), raw):
                held.append(member(record(row["page"], row["url"], payload, row["size"], row["digest"], row["first"])))
                count, size = count + 1, size + len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    held, count, made, size = [], 0, made + 1, 0
        if held:
            yield flush()

    done = marked.select("page", "url", "html", "digest", "size", "first").mapInArrow(run, "file string, records long")
    done.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


SCHEMA = ("record_id string, record_type string, target_uri string, record_date string, payload_digest string, "
          "refers_to string, payload_bytes long, payload binary")
HEADERS = {"record_id": b"warc-record-id", "record_type": b"warc-type", "target_uri": b"warc-target-uri",
           "record_date": b"warc-date", "payload_digest": b"warc-payload-digest", "refers_to": b"warc-refers-to"}


def parse(raw: bytes) -> dict[bytes, bytes]:
    """Header fields by lower-case name, from the lines after the first."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in raw.split(b"\r\n")[1:])}


def members(f) -> Iterator[tuple[bytes, "zlib._Decompress", object]]:
    """Of each member of an open file: the plain text up to the end of the WARC head, and what unpacks the rest."""
    buffer, end = b"", False

    def more(n: int) -> None:
        nonlocal buffer, end
        while len(buffer) < n and not end:
            part = f.read(max(1 << 20, n - len(buffer)))
            end = not part
            buffer += part

    while True:
        more(24)
        if not buffer:
            return
        known = buffer[:2] == b"\x1f\x8b" and buffer[3] == 4 and buffer[12:14] == b"sl"
        size = struct.unpack("<I", buffer[16:20])[0] if known else 0
        more(size or 64 << 10)
        unpack = zlib.decompressobj(31)
        part = buffer[:size] if known else buffer
        plain = unpack.decompress(part, 4096)
        while b"\r\n\r\n" not in plain and not unpack.eof:
            if not unpack.unconsumed_tail and not known:
                if end:
                    raise ValueError("a record breaks off")
                buffer = b""
                more(64 << 10)
                plain += unpack.decompress(buffer, 4096)
            else:
                plain += unpack.decompress(unpack.unconsumed_tail, 4096)

        def rest() -> bytes:
            nonlocal buffer
            out = [plain, unpack.decompress(unpack.unconsumed_tail)]
            while not unpack.eof:
                if end:
                    raise ValueError("a record breaks off")
                buffer = b""
                more(64 << 10)
                out.append(unpack.decompress(buffer))
            return b"".join(out)

        yield plain, unpack, rest
        if known:
            buffer = buffer[size:]
        else:
            if not unpack.eof:
                rest()
            buffer = unpack.unused_data


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payload: bool):
        self.folder, self.payload, self.tests = folder, payload, []

    def pushFilters(self, filters):
        """Takes =, IN and prefix tests of header columns; gives back all others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In | StringStartsWith):
                kind = "=" if isinstance(f, EqualTo) else "in" if isinstance(f, In) else "^"
                self.tests.append((column, kind, tuple(f.value) if kind == "in" else f.value))
            else:
                yield f

    def partitions(self):
        held, size, out = [], 0, []
        for name, n in store.names(self.folder, ".warc.gz"):
            if held and size + n > FILE_BYTES:
                out.append(Files(held))
                held, size = [], 0
            held.append(name)
            size += n
        return [*out, Files(held)] if held else out or [Files([])]

    def passes(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            v = row[column]
            if v is None or (kind == "=" and v != value) or (kind == "in" and v not in value) or (kind == "^" and not v.startswith(value)):
                return False
        return True

    def read(self, partition):
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        fs, path = store.at(self.folder)
        for name in partition.names:
            with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                for plain, _, rest in members(f):
                    at = plain.index(b"\r\n\r\n") + 4
                    fields = parse(plain[:at])
                    row = {c: v.decode() if (v := fields.get(h)) is not None else None for c, h in HEADERS.items()}
                    if not self.passes(row):
                        continue
                    wanted = self.payload and row["record_type"] == "response"
                    plain = rest() if wanted or b"\r\n\r\n" not in plain[at:] else plain
                    begin = plain.index(b"\r\n\r\n", at) + 4
                    row["payload_bytes"] = int(parse(plain[at:begin])[b"content-length"])
                    row["payload"] = plain[begin:at + int(fields[b"content-length"])] if wanted else None
                    rows.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > blocks.SLICE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(folder)``"""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true")


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Records of all archives in a folder; ``payload`` is null for revisits, and for all records if not wanted."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)

"""WARC archives: whole-file gzip streams, their normal form (a member for each record) and a sidecar index.

write_archives writes one record per page into monolithic .warc.gz files, one a task; normalise inflates such a file once
as a stream, writes every record as a gzip member of its own and notes offset and length in a sidecar .cdx.jsonl; read_back
goes through the sidecar and inflates single members. Records with equal payloads of at least `least` bytes are written
once, as the response of the largest id; the others become revisits that name it.

Files go to the shared folder by its URI (file:, hdfs:, s3: ..., whatever Arrow opens) under a name of their own attempt,
and get their final name when complete, so a repeated task leaves the same file.

Defined cases: a null payload is empty; null urls are written as an empty target; ids that repeat keep one record a
row; a null id is less than any other, its record has a name without an id and comes back as null; an empty table gives no archives and an empty result; extra columns are left alone; payloads of any length are held
one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import cut, opened, partitions, shared_dir

CHUNK = 1 << 20
#: Fast compression: archives are written twice and read twice.
LEVEL = 1


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: dict[str, object], block: bytes) -> bytes:
    """One WARC/1.1 record; header values can't break lines."""
    lines = [f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}" for k, v in headers.items()]
    head = "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The response record of a page, or its revisit of another page with the same payload."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    headers = {"WARC-Record-ID": name(page), "WARC-Target-URI": url or "", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http;msgtype=response"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record("response", headers, http + payload)
    return record("revisit", headers | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(refers_to)}, http)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, one at a time."""
    buffer, need, at_end = bytearray(), None, False
    while True:
        if need is None and (end := buffer.find(b"\r\n\r\n")) >= 0:
            head = bytes(buffer[:end]).decode("utf-8", "replace").lower()
            need = end + 4 + next(int(line.split(":", 1)[1]) for line in head.split("\r\n") if line.startswith("content-length:")) + 4
        if need is not None and len(buffer) >= need:
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
            continue
        if at_end:
            if buffer.strip():
                raise ValueError("the archive ends within a record")
            return
        chunk = next(chunks, None)
        at_end = chunk is None
        buffer += chunk or b""


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces of bounded size."""
    z = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            yield z.decompress(data, CHUNK)
            data = z.unconsumed_tail
            if z.eof:
                data = z.unused_data
                z = zlib.decompressobj(31)
    yield z.flush()


class Whole:
    """A file that gets its name only when it is complete."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = opened(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.own = name, f"{self.folder}/.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own)

    def close(self) -> None:
        """Give the file its name; where another attempt was quicker, its equal file stays (HDFS refuses to move onto a name)."""
        self.out.close()
        name = f"{self.folder}/{self.name}"
        try:
            if self.fs.get_file_info(name).type == pa.fs.FileType.NotFound:
                self.fs.move(self.own, name)
                return
        except OSError:
            if self.fs.get_file_info(name).type == pa.fs.FileType.NotFound:
                raise
        self.fs.delete_file(self.own)


def choose_responses(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages(id, digest, size) -> (key, refers_to) of the rows that revisit another; key is row_key's."""
    largest = pages.where(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    thin = pages.where(F.col("size") >= least).join(largest.select("digest", "top"), "digest")
    return thin.where(~F.col("id").eqNullSafe(F.col("top"))).select(row_key(F.col("id"), F.col("digest")).alias("key"), F.col("top").alias("refers_to")).distinct()


def row_key(page: Column, sha1: Column) -> Column:
    """Stands for the rows of an id with one payload."""
    return F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("-")), F.hex(sha1))


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Monolithic archives of all pages in `folder`; returns (name, records) of each. Only pages that may be revisits are shuffled."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    sha1 = F.unhex(F.sha1("payload"))
    thin = cut(rows.select("id", sha1.alias("digest"), F.octet_length("payload").alias("size")), "warc-keys")
    revisits = cut(choose_responses(thin, least), "warc-revisits")
    apart, near = bloom.split(rows.withColumn("key", row_key(F.col("id"), sha1)), revisits.select("key"))
    near = near.join(revisits.hint("merge"), "key", "left").select("id", "url", "payload", "refers_to")
    rows = apart.select("id", "url", "payload", F.lit(None).cast("long").alias("refers_to")).unionByName(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, z, count, name = None, zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to")), strict=True):
                file = file or Whole(folder, name)
                file.out.write(z.compress(page_record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py())))
                count += 1
        if file:
            file.out.write(z.flush())
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["name", "records"])

    return cut(rows.mapInArrow(run, "name string, records long"), "warc-written")


def normalise(names: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrite the archives names(name) of `source` into `folder` with a sidecar each; returns (name, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(source)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                archive, index, at, count = Whole(folder, name), Whole(folder, f"{name}.cdx.jsonl"), 0, 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in records_of(inflated(stream)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        headers, _ = parse(data[: data.find(b"\r\n\r\n") + 4])
                        archive.out.write(member)
                        index.out.write((json.dumps({"id": headers["warc-record-id"], "type": headers["warc-type"], "offset": at, "length": len(member)}) + "\n").encode())
                        at, count = at + len(member), count + 1
                archive.close()
                index.close()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([at], pa.int64())], ["name", "records", "bytes"])

    own = names.select("name").repartition(partitions(names.sparkSession), "name")
    return cut(own.mapInArrow(run, "name string, records long, bytes long"), "warc-normal")


def read_back(names: DataFrame, folder: str) -> DataFrame:
    """A row per record of the normalised archives names(name), each inflated from its own member as the sidecar says."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        number = lambda urn: int(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page:>" else None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_file(f"{path}/{name}") as archive, fs.open_input_stream(f"{path}/{name}.cdx.jsonl") as lines:
                    for line in lines.read().splitlines():
                        entry = json.loads(line)
                        headers, block = parse(zlib.decompress(archive.read_at(entry["length"], entry["offset"]), 31))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        said, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                        if kind == "response" and (len(payload) != size or digest(payload) != said):
                            raise ValueError(f"damaged record {headers['warc-record-id']}")
                        rows.append((number(headers["warc-record-id"]), size, said, kind, number(headers.get("warc-refers-to")), headers["warc-target-uri"], payload if kind == "response" else None))
                        held += len(payload)
                        if held > CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return names.select("name").repartition(partitions(names.sparkSession), "name").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages(page_id, url, html) as archives, normalise them and read them back."""
    spark = pages.sparkSession
    whole, members = shared_dir(spark, "warc-whole"), shared_dir(spark, "warc-members")
    return read_back(normalise(write_archives(pages, whole, least), whole, members), members)

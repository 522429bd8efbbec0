"""Web archives packed in ZIP files: writing them, and range reads without extraction.

An archive is a ZIP file whose members are stored, not deflated: the WARC file
(each record its own gzip member) and an index with the place of each record.
A reader needs the end of the file, the central directory (ZIP64 too), the
index and then only the ranges of the records it wants.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .base import land, place

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of compressed records after which a task starts another archive.
ROLL = 64 << 20
#: Records that lie next to each other are read together up to so many bytes.
SPAN = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(uri)


# --- ZIP ---------------------------------------------------------------------


class StoredZip:
    """Members of a ZIP file by ranges; ``file`` is any seekable reader."""

    def __init__(self, file, size: int):
        self.file, self.members, self._starts = file, {}, {}
        tail_at = max(0, size - (1 << 16) - 22 - 20 - 56)
        tail = self._read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        count, length, begin = struct.unpack_from("<10xHII", tail, at)
        if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
            (end64,) = struct.unpack_from("<8xQ", tail, at - 20)
            count, length, begin = struct.unpack_from("<32xQQQ", self._read(end64, 56))
        directory, at = self._read(begin, length), 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            method, packed, full, name, extra, note, offset = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)
            title = directory[at + 46 : at + 46 + name].decode("utf-8")
            wide, end = at + 46 + name, at + 46 + name + extra
            while wide + 4 <= end:
                kind, n = struct.unpack_from("<HH", directory, wide)
                if kind == 1:  # ZIP64: only the fields that do not fit, in this order
                    values = iter(struct.unpack_from(f"<{n // 8}Q", directory, wide + 4))
                    full = next(values) if full == 0xFFFFFFFF else full
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    offset = next(values) if offset == 0xFFFFFFFF else offset
                wide += 4 + n
            self.members[title] = (method, packed, full, offset)
            at = end + note

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the archive ends too early")
        return data

    def _start(self, name: str) -> int:
        if name not in self._starts:
            method, _, _, offset = self.members[name]
            if method != 0:
                raise ValueError(f"{name} is not stored")
            head = self._read(offset, 30)
            if head[:4] != b"PK\3\4":
                raise ValueError(f"{name} has no local header")
            self._starts[name] = offset + 30 + sum(struct.unpack_from("<HH", head, 26))
        return self._starts[name]

    def range(self, name: str, at: int, n: int) -> bytes:
        """``n`` bytes of a stored member from ``at`` on."""
        if at < 0 or n < 0 or at + n > self.members[name][2]:
            raise ValueError(f"range outside {name}")
        return self._read(self._start(name) + at, n)

    def whole(self, name: str) -> bytes:
        return self.range(name, 0, self.members[name][2])


# --- WARC --------------------------------------------------------------------


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """Header text without line ends and other control characters."""
    return "".join(c if " " <= c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP head but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_line(page_id or '')}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url or '')}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    if revisit:
        fields += [f"WARC-Refers-To: <urn:page:{_line(refers_to or '')}>", f"WARC-Profile: {PROFILE}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and the payload of a record; names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    own = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return fields, own, payload


# --- Spark -------------------------------------------------------------------


def with_revisits(pages: DataFrame, key: str, text: str, url: str, least: int) -> DataFrame:
    """``__id, __url, __payload, __revisit, __refers``: which records repeat the payload of another.

    Payloads are grouped as small rows (length and SHA-256); only what a
    revisit refers to is then joined to the pages.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("__key"), F.col(url).cast("string").alias("__url"), body.alias("__payload"))
    marks = rows.select("__key", F.sha2("__payload", 256).alias("__mark"), F.octet_length("__payload").alias("__size")).filter(F.col("__size") >= least)
    groups = marks.groupBy("__size", "__mark").agg(F.max("__key").alias("__keep"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    again = marks.join(groups, ["__size", "__mark"]).filter(~F.col("__key").eqNullSafe(F.col("__keep"))).select(
        F.col("__key").alias("__again"), "__mark", "__keep").distinct()
    # A key may stand for several payloads, so the payload's hash takes part.
    marked = rows.withColumn("__own", F.sha2("__payload", 256))
    joined = marked.join(again, F.col("__key").eqNullSafe(F.col("__again")) & (F.col("__own") == F.col("__mark")), "left")
    return joined.select(
        F.col("__key").cast("string").alias("__id"), "__url", "__payload", F.col("__mark").isNotNull().alias("__revisit"),
        F.col("__keep").cast("string").alias("__refers"))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", text: str = "html", url: str = "url", least: int = 0, roll: int = ROLL) -> DataFrame:
    """Write all pages as archives under ``folder``; returns the landed manifest ``path, size, records``.

    Of records with equal payloads of at least ``least`` bytes the one with the
    largest key is a response, the others are revisits. Each attempt of a task
    writes files of its own; the manifest has those of the attempt that Spark
    commits, so a lost executor leaves nothing wrong behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        n, stream, archive, member, index, at = 0, None, None, None, [], 0

        def close():
            member.close()
            archive.writestr(INDEX, "".join(index))
            archive.close()
            size = stream.tell()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([len(index)], pa.int64())], ["path", "size", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                if member is None:
                    path = f"{root}/{context.partitionId():06d}-{context.taskAttemptId()}-{n:05d}.wacz"
                    stream = system.open_output_stream(path)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    member, index, at, n = archive.open(WARC, "w", force_zip64=True), [], 0, n + 1
                data = gzip.compress(record(row["__id"], row["__url"], row["__payload"], row["__refers"], row["__revisit"]), 1, mtime=0)
                member.write(data)
                told = json.dumps({"url": _line(row["__url"] or ""), "offset": at, "length": len(data)})
                index.append(f"{_line(row['__id'] or '')} {DATE} {told}\n")
                at += len(data)
                if at >= roll:
                    yield close()
                    member = None
        if member is not None:
            yield close()

    schema = StructType([StructField("path", StringType()), StructField("size", LongType()), StructField("records", LongType())])
    return land(with_revisits(pages, key, text, url, least).mapInArrow(run, schema), "manifest")


def records(path: str, system: pa.fs.FileSystem, size: int) -> Iterator[tuple[dict, dict, bytes]]:
    """All records of one archive, by ranges of its index."""
    with system.open_input_file(path) as file:
        archive = StoredZip(file, size)
        places = [json.loads(line.split(" ", 2)[2]) for line in archive.whole(INDEX).decode("utf-8").splitlines()]
        places.sort(key=lambda p: p["offset"])
        i = 0
        while i < len(places):
            j, begin = i, places[i]["offset"]
            while j + 1 < len(places) and places[j + 1]["offset"] == places[j]["offset"] + places[j]["length"] and places[j + 1]["offset"] - begin < SPAN:
                j += 1
            data = archive.range(WARC, begin, places[j]["offset"] + places[j]["length"] - begin)
            for p in places[i : j + 1]:
                start = p["offset"] - begin
                yield parse(zlib.decompress(data[start : start + p["length"]], 31))
            i = j + 1


def read_archives(manifest: DataFrame, folder: str, key: str, kind) -> DataFrame:
    """``key, payload_bytes, payload_digest, record_type, refers_to, url`` of all records of the archives.

    The payload of a response is checked against its digest.
    """
    names = ["__id", "payload_bytes", "payload_digest", "record_type", "__refers", "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                out: list[tuple] = []
                for fields, http, payload in records(row["path"], system, row["size"]):
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and sha1_base32(payload) != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                    n = int(http["content-length"]) if revisit else len(payload)
                    page = lambda name: fields[name].removeprefix("<urn:page:").removesuffix(">") or None  # noqa: B023, E731
                    out.append((page("warc-record-id"), n, digest, fields["warc-type"], page("warc-refers-to") if revisit else None, fields["warc-target-uri"]))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    schema = StructType([StructField(c, LongType() if c == "payload_bytes" else StringType()) for c in names])
    each = max(1, min(manifest.count(), 10_000))
    found = manifest.repartition(each).mapInArrow(run, schema)
    return found.select(
        F.col("__id").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("__refers").cast(kind).alias("refers_to"), "url")


def archived(pages: DataFrame, key: str = "page_id", text: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: one row per page.

    Null texts have an empty payload; null urls are empty. Rows that repeat a
    key are records of their own; with equal payloads each of them is a
    response if their key is the largest, else each a revisit. Null keys come
    back null. An empty table gives an empty result; other columns are not read.
    """
    folder = place(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, folder, key, text, url, least), folder, key, pages.schema[key].dataType)

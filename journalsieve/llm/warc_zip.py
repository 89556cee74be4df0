"""WARC records packed in ZIP archives: written once, then read by ranges without extraction.

An archive holds two stored members: gzip-compressed WARC records, one gzip member each, and an index of
their places.  The reader parses the central directory (with its ZIP64 forms) from the archive's tail,
finds the stored members and the index in it, and turns every index line into a byte range of the archive.
The ranges are dealt over the cluster and read on their own.

Files go through ``pyarrow.fs``, so archives may lie in any store it knows; a task writes under a name of
its attempt and moves the finished archive into place, so repeated tasks leave whole archives only.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from journalsieve.llm.common import own_columns
from journalsieve.workspace import new_folder, settle

RECORDS, INDEX = "archive/records.warc.gz", "indexes/records.cdxj"
#: Bytes after which a task begins another archive, and bytes one range request spans at most.
ARCHIVE_BYTES, SPAN = 64 << 20, 4 << 20
DATE = "1970-01-01T00:00:00Z"  # pages carry no date
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"

# signatures and fixed parts of the ZIP format
_END, _END64, _LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_CENTRAL, _LOCAL = b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    stored_size: int
    size: int
    header_at: int


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


# --- reading ZIP archives by ranges -------------------------------------------------------------------

def central_directory(read: Callable[[int, int], bytes], size: int) -> list[Member]:
    """The members named by the central directory; ``read(offset, length)`` gives bytes of the archive."""
    tail_at = max(0, size - (22 + _FULL16))
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(_END)
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20:end + 22], "little") > len(tail):
        end = tail.rfind(_END, 0, end)
    if end < 0 or len(tail) - end < 22:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if count == _FULL16 or length == _FULL32 or at == _FULL32:
        locator = read(tail_at + end - 20, 20)
        if locator[:4] != _LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, at = struct.unpack_from("<QQQ", end64, 32)
    directory, members, place = read(at, length), [], 0
    for _ in range(count):
        if directory[place:place + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, place + 10)
        stored, full = struct.unpack_from("<II", directory, place + 20)
        name_size, extra_size, comment_size = struct.unpack_from("<HHH", directory, place + 28)
        header_at, = struct.unpack_from("<I", directory, place + 42)
        flags, = struct.unpack_from("<H", directory, place + 8)
        name = directory[place + 46:place + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[place + 46 + name_size:place + 46 + name_size + extra_size]
        wide = _zip64_fields(extra)
        if full == _FULL32:
            full = next(wide)
        if stored == _FULL32:
            stored = next(wide)
        if header_at == _FULL32:
            header_at = next(wide)
        members.append(Member(name, method, stored, full, header_at))
        place += 46 + name_size + extra_size + comment_size
    return members


def _zip64_fields(extra: bytes) -> Iterator[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            yield from struct.unpack_from(f"<{length // 8}Q", extra, at + 4)
        at += 4 + length


def data_start(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where a stored member's bytes begin; a compressed member has no ranges to read."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    header = read(member.header_at, 30)
    if header[:4] != _LOCAL:
        raise ValueError(f"no local header of {member.name}")
    name_size, extra_size = struct.unpack_from("<HH", header, 26)
    return member.header_at + 30 + name_size + extra_size


def record_ranges(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, int]]:
    """(offset in the archive, length) of every record that the archive's indexes name."""
    members = {m.name: m for m in central_directory(read, size)}
    starts = {m.name.rsplit("/", 1)[-1]: data_start(read, m) for m in members.values()
              if m.name.startswith("archive/") and m.method == 0}
    for member in members.values():
        if member.name.startswith("indexes/") and member.name.endswith(".cdxj"):
            lines = read(data_start(read, member), member.size).decode().splitlines()
            for line in lines:
                entry = json.loads(line.split(" ", 2)[2])
                yield starts[entry["filename"]] + int(entry["offset"]), int(entry["length"])


# --- WARC records -------------------------------------------------------------------------------------

def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, number: int = 1) -> str:
    """A URI of the page; further rows of one page and payload are numbered."""
    return f"<{_URN}{'' if page_id is None else page_id}{f':{number}' if number > 1 else ''}>"


def page_of(record: str) -> int | None:
    page = record.strip("<>").removeprefix(_URN).split(":")[0]
    return int(page) if page else None


def write_record(page_id: int | None, number: int, url: str | None, payload: bytes, digest: str,
                 revisits: bool, refers_to: int | None) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisits else http + payload
    fields = {"WARC-Type": "revisit" if revisits else "response", "WARC-Record-ID": record_id(page_id, number),
              "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest}",
              "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    if url is not None:
        fields["WARC-Target-URI"] = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url)
    if revisits:
        fields |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": record_id(refers_to)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(1, wbits=31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def read_record(packed: bytes) -> dict:
    """Fields, payload (None for a revisit) and the payload's full size of one packed record."""
    data = zlib.decompress(packed, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    sizes = [int(x.split(":")[1]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (base32_sha1(payload) != digest or len(payload) != sizes[0]):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"], "payload": None if revisit else payload,
            "payload_bytes": sizes[0], "payload_digest": digest,
            "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None}


# --- Spark jobs ---------------------------------------------------------------------------------------

def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least: int = 0) -> DataFrame:
    """(id, url, html, sha, number, revisits, refers_to): which rows revisit which.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest id is the response.
    Rows that share id and payload are numbered; the first counts, the others revisit it.  Null html is
    an empty payload; a null id ranks below all others.  Only ids and digests meet by digest, where a
    hot payload is one partial maximum per task; the html moves once, by id and digest.
    """
    rows = own_columns(pages, id=id_col, url=url_col, html=html_col).select(
        F.col("id").cast("long"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # the join and the numbering use one partitioning, so a null id needs a key of its own
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit("")))
    ids = rows.select("id", "key", "sha").distinct()
    leaders = ids.groupBy("sha").agg(F.max("id").alias("leader"))
    joined = rows.join(ids.join(leaders, "sha").select("key", "sha", "leader"), ["key", "sha"])
    number = F.row_number().over(Window.partitionBy("key", "sha").orderBy("url"))
    later = ~F.col("id").eqNullSafe(F.col("leader")) | (F.col("number") > 1)
    revisits = later & (F.octet_length("html") >= least)
    return joined.withColumn("number", number).select(
        "id", "url", "html", "sha", "number", revisits.alias("revisits"),
        F.when(revisits, F.col("leader")).alias("refers_to"))


class _Archive:
    """One archive being written: records go straight to the store, index lines wait for the end."""

    def __init__(self, folder: str, name: str, attempt: str):
        self.system, root = file_system(folder)
        self.system.create_dir(root, recursive=True)
        self.final, self.draft = f"{root}/{name}", f"{root}/_{name}-{attempt}"
        self.uri = f"{folder}/{name}"
        self.out = self.system.open_output_stream(self.draft)
        self.zip = zipfile.ZipFile(_Unseekable(self.out), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(RECORDS, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, packed: bytes, url: str | None, digest: str) -> None:
        self.member.write(packed)
        entry = {"url": url or "", "digest": f"sha1:{digest}", "offset": str(self.at),
                 "length": str(len(packed)), "filename": RECORDS.rsplit("/", 1)[-1]}
        self.lines.append(f"- {DATE[:4]} {json.dumps(entry)}")
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(INDEX, "".join(f"{x}\n" for x in self.lines))
        self.zip.close()
        self.out.close()
        self.system.move(self.draft, self.final)
        return self.uri, len(self.lines), self.at


class _Unseekable(io.RawIOBase):
    """An output stream of a store that only appends."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of ``with_revisits`` into archives under ``folder``; (path, records, bytes) of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, done = TaskContext.get(), None, []
        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    archive = _Archive(folder, f"part-{task.partitionId():06d}-{len(done):04d}.zip",
                                       f"{task.taskAttemptId()}")
                digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                archive.add(write_record(row["id"], row["number"], row["url"], row["html"].encode(), digest,
                                         row["revisits"], row["refers_to"]), row["url"], digest)
                if archive.at >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    return settle(records.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_archives(archives: DataFrame, path_col: str = "path", span: int = SPAN) -> DataFrame:
    """Every record of the archives: page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    Directories and indexes are read first, one small task per archive; the ranges they name are dealt by
    archive and stretch of ``span`` bytes, and a task joins neighbouring ranges into one request.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = file_system(path)
                with system.open_input_file(place) as file:
                    found = list(record_ranges(lambda at, n: file.read_at(n, at), file.size()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()),
                     pa.array([f[1] for f in found], pa.int64())], names=["path", "offset", "length"])

    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            start = 0
            while start < len(rows):
                path, at, length = rows[start]
                end, until = start + 1, at + length
                while end < len(rows) and rows[end][0] == path and rows[end][1] == until < at + span:
                    until += rows[end][2]
                    end += 1
                system, place = file_system(path)
                with system.open_input_file(place) as file:
                    data = file.read_at(until - at, at)
                found = [read_record(data[o - at:o - at + n]) for _, o, n in rows[start:end]]
                start = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[n] for f in found], t) for n, t in zip(names, types)], names=names)

    # index lines are small but stand for many bytes, so the number of tasks follows from the archives
    total = archives.agg(F.sum("bytes")).head()[0] if "bytes" in archives.columns else None
    parts = -(-total // (4 * span)) if total else archives.sparkSession.sparkContext.defaultParallelism
    paths = archives.select(F.col(path_col).alias("path"))
    ranges = paths.repartition("path").mapInArrow(locate, "path string, offset long, length long")
    dealt = ranges.repartition(
        parts, "path", F.floor(F.col("offset") / (4 * span))).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(fetch, "page_id long, url string, record_type string, payload binary, "
                                   "payload_bytes long, payload_digest string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes one record per row and reads all of them back from the archives."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(with_revisits(pages, least=least), folder))

"""WARC 1.1 archives of pages: written in order of page_id by shards, committed by manifest, checked when read back.

Shards are ranges of page_id cut by exact splitters, so the same table gives the same files, byte for byte, however it is
partitioned. A task sorts its shard and writes one gzip member a record, rolling to the next file when ``ROLL_BYTES``
compressed bytes are reached. Headers, digests and record ids are made anew from the page. Of records with
equal payloads the one with the smallest page_id is a ``response``, the others are ``revisit`` records (profile
identical-payload-digest) that carry the HTTP header alone. Which these are is found on digests (a partial aggregate; groups of
over a thousandth of all rows, at most a thousand, are broadcast, the others joined) and told to the writer by notes that are
sorted in before the pages, so a page itself is shuffled once.

Every attempt of a task writes under names of its own; the rows that Spark commits say which attempt counts. Those files are renamed,
their list is written as Parquet and ``MANIFEST`` (one line, published by rename) names that list: the commit. A reader goes by
the manifest and holds every file against its size and SHA-256, every record against its digests, every revisit against
the response it refers to. Workers read and write through ``pyarrow.fs``, so the folder may be a path on a shared file system or of
any store that it knows (hdfs, s3, gs).

Defined results: a null html is an empty payload; a null url has no WARC-Target-URI, white space and control characters
of urls are percent-encoded; null page_ids come last; rows that repeat page_id and payload are one response at most and
revisits of it. Pages have no date, so WARC-Date is a parameter. An empty table has no archives and gives an empty result.
Very long pages are one record each, held in memory one at a time. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feltloom.llm.common import importable, kept_path, rows_of, sliced, write_shared
from feltloom.llm.files import Files
from feltloom.llm.splitters import exact_splitters, spread_range_of

#: Compressed bytes after which a file is full; payload bytes of a shard; shards at most.
ROLL_BYTES, SHARD_BYTES, SHARDS = 64 << 20, 32 << 20, 4096
DATE = "2024-01-01T00:00:00Z"
_FILES = "name string, draft string, records long, bytes long, sha256 string"
INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, url string"
_LAST = (1 << 63) - 1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{digest}:{copy}>"


def page_of(record: str) -> int | None:
    found = record.split(":")[2]
    return None if found == "none" else int(found)


def safe_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record with its block's digest and length."""
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def info_record(name: str, date: str) -> bytes:
    block = b"software: feltloom\r\nformat: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def page_record(page_id: int | None, url: str | None, payload: bytes, copy: int, refers_to: str | None, date: str) -> bytes:
    """A response, or a revisit of the record ``refers_to``, which leaves the payload out."""
    digest = base32_sha1(payload)
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", safe_url(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", _PROFILE)]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(fields, head if refers_to else head + payload)


def gzip_member(data: bytes) -> bytes:
    """The same bytes for the same data: no time, no name."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Rolling:
    """The files of one shard, one after another under names of this attempt."""

    def __init__(self, folder: str, shard: int, roll: int, date: str):
        self.fs, self.path = pa.fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.date, self.attempt = shard, roll, date, uuid.uuid4().hex
        self.out, self.rows = None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:05d}-{len(self.rows):05d}.warc.gz"
            self.draft = f"_drafts/{self.name}.{self.attempt}"
            self.out, self.records, self.size, self.sum = self.fs.open_output_stream(f"{self.path}/{self.draft}", compression=None), 0, 0, hashlib.sha256()
            self._put(info_record(self.name, self.date))
        self._put(record)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, record: bytes) -> None:
        member = gzip_member(record)
        self.out.write(member)
        self.size += len(member)
        self.sum.update(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.name, self.draft, self.records, self.size, self.sum.hexdigest()))
            self.out = None


def _write(folder: str, roll: int, date: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by page_id and digest, a note of who the response is before the pages it is for."""
        shard, now, owner, copy = TaskContext.get().partitionId(), None, (), 0
        files = _Rolling(folder, shard, roll, date)
        for batch in sliced(batches, "html", 8 << 20):
            for page_id, digest, note, of, url, html in rows_of(batch, "page_id", "digest", "note", "owner", "url", "html"):
                if now != (page_id, digest):
                    now, owner, copy = (page_id, digest), (page_id,), 0
                if note == 0:
                    owner = (of,)
                    continue
                payload = (html or "").encode()
                first = owner == (page_id,) and copy == 0
                files.add(page_record(page_id, url, payload, copy, None if first else record_id(owner[0], base32_sha1(payload), 0), date))
                copy += 1
        files.close()
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in files.rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _FILES.split(", ")])

    return run


def _rename(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, draft, size in rows_of(batch, "name", "draft", "bytes"):
                there = fs.get_file_info(f"{path}/{name}")
                if there.type == pa.fs.FileType.NotFound:
                    fs.move(f"{path}/{draft}", f"{path}/{name}")
                elif there.size != size:
                    raise OSError(f"{name} is there already and is another file")
            yield batch

    return run


def write_archive(pages: DataFrame, folder: str, roll: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files into a new folder and commit them."""
    spark = pages.sparkSession
    importable(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page_id = F.col("page_id").cast("long")
    rows = pages.select(page_id.alias("page_id"), F.coalesce(page_id, F.lit(_LAST)).alias("key"), F.sha1(html.cast("binary")).alias("digest"), F.lit(1).alias("note"), F.lit(None).cast("long").alias("owner"), F.col("url").cast("string").alias("url"), html.alias("html"))
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    Files(spark).make(f"{folder}/_drafts")
    shards = max(1, min(SHARDS, count, -(-size // shard_bytes)))
    starts = exact_splitters(rows.select("key"), -(-count // shards)) if count else [0]
    thin = rows.select("page_id", "key", "digest", "note")
    smallest = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id"))
    groups = write_shared(thin.groupBy("digest").agg(smallest["page_id"].alias("owner"), F.count("*").alias("n")).where("n > 1"), "payloads")
    large = F.col("n") > max(1, count // 1000)  # no more than a thousand groups
    members = thin.select("page_id", "key", "digest").join(F.broadcast(groups.where(large)), "digest").unionByName(thin.select("page_id", "key", "digest").join(groups.where(~large), "digest"))
    notes = members.select("page_id", "key", "digest", F.lit(0).alias("note"), "owner", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    shard = spread_range_of(F.col("key"), F.pmod(F.xxhash64("digest"), F.lit(1 << 20)), starts)
    dealt = rows.unionByName(notes).repartitionById(len(starts), shard).sortWithinPartitions("key", F.col("page_id").isNull(), "digest", "note", "url")
    written = write_shared(dealt.select("page_id", "digest", "note", "owner", "url", "html").mapInArrow(_write(folder, roll, date), _FILES), "archives")
    listed = f"_files-{uuid.uuid4().hex}"
    written.mapInArrow(_rename(folder), _FILES).drop("draft").write.parquet(f"{folder}/{listed}")
    Files(spark).publish(f"{folder}/MANIFEST", json.dumps({"files": listed, "records": count}))
    Files(spark).delete(f"{folder}/_drafts")


@dataclass
class Record:
    kind: str
    fields: dict[str, str]
    block: bytes


def parse_record(data: bytes) -> Record:
    """One record; its block must be as long and have the digest that its header says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
    return Record(fields["WARC-Type"], fields, block)


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked, one in memory at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
            data = data or stream.read(chunk)
        else:
            data = stream.read(chunk)
    if any(parts):
        raise ValueError("a file ends within a record")


class _Summed:
    """Reads on and keeps size and SHA-256 of what was read."""

    def __init__(self, stream):
        self.stream, self.size, self.sum = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.size += len(data)
        self.sum.update(data)
        return data


def _page(record: Record) -> tuple[tuple, bytes | None]:
    """The row of a record, and the payload of a response, checked against the digest."""
    digest = record.fields["WARC-Payload-Digest"].removeprefix("sha1:")
    http, _, payload = record.block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    own, refers = record.fields["WARC-Record-ID"], record.fields.get("WARC-Refers-To")
    if record.kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {own} is damaged")
    return (page_of(own), size, digest, record.kind, page_of(refers) if refers else None, own, refers, record.fields.get("WARC-Target-URI")), payload if record.kind == "response" else None


def _read(folder: str, html: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [x.split()[0] for x in INDEX.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [*kinds, pa.string()] if html else kinds
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), columns)], names=[*names, "html"] if html else names)

        for batch in batches:
            for name, records, size, digest in rows_of(batch, "name", "records", "bytes", "sha256"):
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    summed = _Summed(stream)
                    for data in members(summed):
                        record = parse_record(data)
                        if record.kind == "warcinfo":
                            continue
                        row, payload = _page(record)
                        rows.append((*row, payload.decode() if payload is not None else None) if html else row)
                        seen, held = seen + 1, held + 200 + len(data) * html
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if (seen, summed.size, summed.sum.hexdigest()) != (records, size, digest):
                    raise ValueError(f"{name} does not match the manifest")
                if rows:
                    yield batch_of(rows)

    return run


def read_archive(spark: SparkSession, folder: str, html: bool = False) -> DataFrame:
    """A row for each record of the committed files, with ``html`` the payload of responses too; damage raises."""
    importable(spark)
    manifest = json.loads(Files(spark).read(f"{folder}/MANIFEST"))
    listed = spark.read.schema("name string, records long, bytes long, sha256 string").parquet(f"{folder}/{manifest['files']}")
    files = listed.repartition(max(1, min(listed.count(), 100_000)), "name")
    return files.mapInArrow(_read(folder, html), INDEX + ", html string" * html)


def checked_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of an archive, written to the shared folder; raises if a record is missing, or the response that a revisit refers to."""
    index = write_shared(read_archive(spark, folder), "index")
    count = json.loads(Files(spark).read(f"{folder}/MANIFEST"))["records"]
    if index.count() != count:
        raise ValueError(f"the archive has {index.count()} of {count} records")
    same = ["record_id", "payload_digest", "payload_bytes"]
    asked = index.where("record_type = 'revisit'").groupBy(F.col("refers_to_record").alias("record_id"), *same[1:]).agg(F.count("*").alias("n"))
    lost = asked.join(index.where("record_type = 'response'").select(*same), same, "left_anti").first()
    if lost:
        raise ValueError(f"revisits refer to {lost.record_id}, which is not in the archive")
    return index


def archive_report(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write an archive that stays, read it back, and report its pages."""
    spark = pages.sparkSession
    folder = folder or kept_path(spark, "warc")
    write_archive(pages, folder)
    return checked_index(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

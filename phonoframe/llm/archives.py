"""WARC records in ZIP packages: writing, and reading by range without extraction.

A package holds the stored members ``archive/data.warc.gz`` (one gzip member
per record), ``indexes/index.cdxj`` (one line per record with its offset and
length in that member) and ``datapackage.json``. The reader finds the central
directory from the end of the file (ZIP64 included), resolves the data offsets
of the stored members through their local headers, reads the index and then
only the byte ranges of the records.

Tasks open packages through ``pyarrow.fs``, so the folder may be any store that
it knows (file, HDFS, S3, GCS). A task writes packages under names of its own
and reports them; readers see only those that a finished task has reported.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.llm.common import removed_at_exit, scratch_path, table, written

#: Payloads from this many bytes on are kept once.
REVISIT_FROM = 100
#: A package is closed when its records reach this size.
PACKAGE_BYTES = 24 << 20
#: Digests (of some 80 bytes each) up to which the table of first pages is sent to all tasks; beyond, it meets the ids, and payloads are shuffled by page.
BROADCAST_ROWS = 200_000
#: Bytes of records that one reading task takes of a package, about, and reading tasks at most.
PART_BYTES, READERS = 16 << 20, 100_000
#: Neighbouring records are read in one range of at most about this size.
RANGE_BYTES = 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_EOCD, _EOCD64, _LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_CENTRAL, _LOCAL = b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    """An entry of the central directory."""

    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def directory(read: Callable[[int, int], bytes], size: int) -> dict[str, Member]:
    """Members by name. read(offset, length) returns bytes of the file. ValueError for what isn't a ZIP file."""
    tail_at = max(0, size - (22 + _FULL16))
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(_EOCD)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(_EOCD, 0, at)  # the mark may stand in the comment
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == _FULL16 or _FULL32 in (length, start):
        locator = read(tail_at + at - 20, 20)
        if locator[:4] != _LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != _EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    raw, i, found = read(start, length), 0, {}
    for _ in range(count):
        if raw[i : i + 4] != _CENTRAL:
            raise ValueError("the central directory is damaged")
        method, crc, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<H4xIIIHHH", raw, i + 10)
        header = struct.unpack_from("<I", raw, i + 42)[0]
        name = raw[i + 46 : i + 46 + n_name].decode()
        extra = raw[i + 46 + n_name : i + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # its fields stand for those that are full, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = next(wide) if full == _FULL32 else full
                packed = next(wide) if packed == _FULL32 else packed
                header = next(wide) if header == _FULL32 else header
            extra = extra[4 + n :]
        found[name] = Member(name, method, crc, packed, full, header)
        i += 46 + n_name + n_extra + n_comment
    return found


def stored_at(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where the bytes of a stored member begin in the file."""
    if member.method:
        raise ValueError(f"{member.name} is compressed and can't be read by range")
    head = read(member.header, 30)
    if head[:4] != _LOCAL:
        raise ValueError(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit without it. Headers that this library adds begin with X-."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{clean}')}>",
        f"WARC-Target-URI: {clean}", "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of one record. A response's payload is digested anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("the record is cut short")
    digest, n = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
    if fields["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        n, seen = len(payload), hashlib.sha256(payload).hexdigest()
        if seen != digest:
            raise ValueError(f"the payload has digest {seen}, its header {digest}")
    whole = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": whole("x-page-id"), "payload_bytes": n, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": whole("x-refers-to-page-id")}


def package(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP file with these (key, gzipped record) pairs and their index."""
    out, at, lines = io.BytesIO(), 0, []
    for key, raw in records:
        lines.append(f"{key} {json.dumps({'offset': at, 'length': len(raw)})}")
        at += len(raw)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(DATA, "w", force_zip64=at >= 1 << 31) as f:
            for _, raw in records:
                f.write(raw)
        z.writestr(INDEX, "\n".join(lines))
        z.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}))
    return out.getvalue()


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes packages and returns the manifest (path, n_records, n_bytes of them), written.

    pages: page_id, url, html (binary), payload_digest, refers_to (null: a response).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)

        def close(records: list) -> pa.RecordBatch:
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(path) as f:
                f.write(package(records))
            n_bytes = sum(len(raw) for _, raw in records)
            return pa.record_batch([pa.array([path]), pa.array([len(records)], pa.int64()), pa.array([n_bytes], pa.int64())], names=["path", "n_records", "n_bytes"])

        held, size = [], 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*batch.columns, strict=True):
                html = html.as_py() or b""
                raw = gzip.compress(warc_record(page_id.as_py(), url.as_py(), html, digest.as_py(), refers_to.as_py()), 1, mtime=0)
                held.append((str(page_id.as_py()), raw))
                size += len(raw)
                if size >= package_bytes:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return written(pages.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, "path string, n_records long, n_bytes long"), "archive-manifest")


def ranges(index: bytes, most: int = RANGE_BYTES) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring (offset, length) from the lines of an index."""
    run: list[tuple[int, int]] = []
    for line in index.decode().splitlines():
        x = json.loads(line.partition(" ")[2])
        at, n = x["offset"], x["length"]
        if run and (at != sum(run[-1]) or at + n - run[0][0] > most):
            yield run
            run = []
        run.append((at, n))
    if run:
        yield run


def parts_of(manifest: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, part, parts), about as many tasks as rows: packages far larger than `part_bytes` are read by several tasks.

    A manifest is tiny beside what it lists, so its rows are dealt to a stated
    number of tasks, which adaptive execution leaves as it is.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / part_bytes)).cast("int")
    listed = manifest.withColumn("parts", parts)
    tasks = listed.agg(F.sum("parts")).first()[0] or 1
    wide = listed.select("path", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    return wide.repartition(int(min(tasks, READERS)), "path", "part")


def read_packages(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the packages that the manifest lists: the fields of ``parse_record``."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, part, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as f:
                    read = lambda at, n: f.read_at(n, at)  # noqa: E731, B023
                    members = directory(read, f.size())
                    index = members[INDEX]
                    lines = read(stored_at(read, index), index.size)
                    if zlib.crc32(lines) != index.crc:
                        raise ValueError(f"the index of {path} is damaged")
                    base = stored_at(read, members[DATA])
                    for spot in list(ranges(lines))[part::parts]:
                        raw = read(base + spot[0][0], sum(n for _, n in spot))
                        rows = [parse_record(gzip.decompress(raw[at - spot[0][0] : at - spot[0][0] + n])) for at, n in spot]
                        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names=names)

    return parts_of(manifest).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_revisits(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """pages (page_id, url, html) with html as bytes, payload_digest and refers_to.

    Of equal payloads of at least `revisit_from` bytes the smallest page_id is
    the response; rows that repeat that page_id are responses too. Null html is
    an empty payload. A null page_id is no candidate unless all are null.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    slim = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("payload_digest"))
    # Only digests that occur twice have anything to refer to: a row for each, however large a group is.
    first = (
        pages.select("page_id", payload.alias("html")).where(F.octet_length("html") >= revisit_from)
        .groupBy(F.sha2("html", 256).alias("payload_digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    )
    first = written(first, "archive-first")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to")
    names = ["page_id", "url", "html", "payload_digest"]
    if first.count() <= BROADCAST_ROWS:
        return slim.join(F.broadcast(first), "payload_digest", "left").select(*names, refers)  # payloads stay where they are
    # Ids meet their digest's first page; payloads are dealt by their own page, however many are equal.
    ids = slim.select("page_id", "payload_digest").distinct().join(first, "payload_digest").select("page_id", "payload_digest", refers).where("refers_to is not null")
    same = F.col("p.page_id").eqNullSafe(F.col("i.page_id")) & (F.col("p.payload_digest") == F.col("i.payload_digest"))
    return slim.alias("p").join(ids.alias("i"), same, "left").select(*[f"p.{c}" for c in names], "i.refers_to")


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all pages into packages under `folder` (default: the shared folder) and reads their records back.

    An empty table gives no packages and no rows; null urls are written empty.
    """
    own = folder is None
    folder = folder or scratch_path(pages.sparkSession, "archive")
    manifest = write_packages(with_revisits(pages), folder)
    if own:
        removed_at_exit(pages.sparkSession, folder)
    return read_packages(manifest, folder)


def op5_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in ZIP packages, read back by range (the contract of ``with_revisits``)."""
    return archived(table(spark, sf_dir, "pages"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT page_id, n, d, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""

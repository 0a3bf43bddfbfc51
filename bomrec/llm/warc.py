"""WARC archives: a writer that deduplicates payloads and a reader that splits compressed archives."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomrec.llm.common import kept, shared_dir

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, at long, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder or file that all tasks can reach, by its URI."""
    path = re.sub(r"^file:/+", "/", path)
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(key) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def record(kind: str, key, url: str | None, payload: bytes, date: str, refers_to=None) -> bytes:
    """One WARC record as a gzip member. A revisit has no payload but states its digest and length."""
    block = HTTP + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(key)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {IDENTICAL}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = 0, archive_bytes: int = 1 << 28, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record for each row; returns the manifest (path, length, records) of the archives.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id is the
    response and the others revisit it; rows that repeat that id and payload are responses too. A null
    payload is empty; a null id is the smallest and is written as the empty id.

    Each task attempt writes files of its own name, so a lost or doubled attempt leaves files that no
    manifest names. The manifest is kept: it has a row for each archive.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("string").alias("key"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    repeated = (
        rows.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.min(F.struct("id", "key")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("sha", F.col("first.key").alias("first"), F.lit(True).alias("shared"))
    )
    rows = rows.join(repeated, "sha", "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("key").eqNullSafe(F.col("first"))
    rows = rows.select("key", "url", "payload", "first", revisit.alias("revisit"))

    def write(batches):
        task = TaskContext.get()
        files, root = opened(folder)
        files.create_dir(root, recursive=True)
        made, out, name, n, size = [], None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = files.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = record("revisit" if row["revisit"] else "response", row["key"], row["url"], row["payload"], date, row["first"])
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    made.append((f"{folder}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            made.append((f"{folder}/{name}", size, n))
        paths, sizes, counts = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["path", "length", "records"]
        )

    return kept(rows.mapInArrow(write, "path string, length long, records long"))


def parsed(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and block of a record, or None if these bytes are not one whole WARC record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/\d+\.\d+", lines[0]) or any(":" not in x for x in lines[1:]):
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = headers.get("content-length", "")
    if not length.isdigit() or rest[int(length) :] != b"\r\n\r\n" or "warc-type" not in headers:
        return None
    return headers, rest[: int(length)]


def member(file, at: int) -> tuple[bytes, int] | None:
    """The bytes of the gzip member at ``at`` and where it ends; None if what is there is no WARC member."""
    unpacker, raw, here = zlib.decompressobj(31), bytearray(), at
    try:
        while not unpacker.eof:
            data = file.read_at(min(CHUNK, 1 << 16) if here == at else CHUNK, here)
            if not data:
                return None
            here += len(data)
            raw += unpacker.decompress(data)
            if not b"WARC/".startswith(bytes(raw[:5])):
                return None
    except zlib.error:
        return None
    return bytes(raw), here - len(unpacker.unused_data)


def find_magic(file, at: int, stop: int) -> int | None:
    """The first gzip magic that begins in [at, stop)."""
    while at < stop:
        data = file.read_at(min(CHUNK, stop - at) + len(MAGIC) - 1, at)
        hit = data.find(MAGIC)
        if hit >= 0:
            return at + hit
        at += CHUNK
    return None


def records_from(file, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records whose member begins in [start, stop), read to their end wherever it is."""
    at = start
    while (at := find_magic(file, at, stop)) is not None:
        found = member(file, at)
        record_ = found and parsed(found[0])
        if record_:
            yield at, *record_
            at = found[1]
        else:
            at += 1


def read_archives(archives: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """Records of the archives in a manifest (path, length), read in byte ranges by independent tasks.

    A task looks for the gzip magic in its range, accepts a place only if a whole gzip member decodes
    there to a WARC record whose headers and stated length fit, and owns the records that begin in its
    range; it reads the last one past the range's end. No index and no scan from the top is needed. The
    payload of a response is checked against its digest. Records that are neither response nor revisit
    are passed over, as are bytes that are no record. Empty archives and an empty manifest give no rows.
    """
    ranges = archives.where("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    ranges = ranges.select("path", "start", F.least("length", F.col("start") + split_bytes).alias("stop"))
    n = max(1, archives.agg(F.sum(F.ceil(F.col("length") / split_bytes))).head()[0] or 1)
    ranges = ranges.repartition(min(int(n), 1 << 16), "path", "start")

    def read(batches):
        for batch in batches:
            for part in batch.to_pylist():
                files, path = opened(part["path"])
                with files.open_input_file(path) as file:
                    rows = []
                    for at, headers, block in records_from(file, part["start"], part["stop"]):
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        size = len(payload) if payload is not None else int(headers.get("x-payload-length", 0))
                        if payload is not None and digest(payload) != stated:
                            raise ValueError(f"payload of the record at {part['path']}:{at} does not match its digest")
                        rows.append((part["path"], at, headers.get("warc-record-id"), kind, headers.get("warc-target-uri"),
                                     headers.get("warc-refers-to"), size, stated, payload if with_payload else None))
                        if len(rows) >= 256:
                            yield table(rows)
                            rows = []
                    yield table(rows)

    def table(rows):
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], COLUMNS)

    return ranges.mapInArrow(read, RECORD)


def archive_folder(spark) -> str:
    return f"{shared_dir(spark)}/bomrec-warc-{uuid.uuid4().hex}"

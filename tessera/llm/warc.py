"""WARC archives: written as monolithic gzip files, normalised to one gzip member per record, and read back.

1. Records are written by the tasks as whole-file gzip streams, as older crawlers left them; a stream is
   closed after about ARCHIVE bytes of payload.
2. The normaliser takes one such file at a time, inflates its stream once in blocks, finds the records by
   their Content-Length, writes each as a gzip member of its own, and notes (record, offset, length) in a
   sidecar index beside the archive.
3. Reading back follows the index in blocks of records: each task seeks to its first member and inflates
   members one by one.

Files go to the session's shared folder through Arrow's file systems, under names that hold the task
attempt; only the names that successful tasks return are used, so a lost or repeated task does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, cut, shared_dir

#: Bytes that are read or written at a time.
BLOCK = 1 << 20
#: Records that one task reads back, and bytes of payload after which an archive is closed.
RECORDS, ARCHIVE = 2_000, 256 << 20
#: Parts of the rows of one payload, where the repeated payloads are too many to be sent to every task.
SALTS = 32
#: Fixed value of the format: the identical-payload-digest profile of revisit records.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str, kind: str, payload: bytes, sha: str, full: int, refers: int | None) -> bytes:
    """One record. A revisit has no block; both kinds tell the full payload's size and digest."""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {full}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x)


def inflate(source) -> Iterator[bytes]:
    """Blocks of the inflated bytes of an open gzip file, over all its members."""
    d = zlib.decompressobj(31)
    while block := source.read(BLOCK):
        while block:
            out = d.decompress(block, BLOCK)
            if out:
                yield out
            if d.eof:
                block = d.unused_data
                d = zlib.decompressobj(31)
            else:
                block = d.unconsumed_tail
    if tail := d.flush():
        yield tail


def records(blocks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(head, body) of each record in a stream of bytes."""
    buffer = bytearray()

    def more() -> bool:
        got = next(blocks, None)
        if got is None:
            return False
        buffer.extend(got)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if bytes(buffer).strip():
                    raise ValueError("a record's head is cut off")
                return
        head = bytes(buffer[:end])
        size = int(parse_head(head)["Content-Length"])
        while len(buffer) < end + 4 + size + 4:
            if not more():
                raise ValueError("a record's body is cut off")
        yield head, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size + 4]


def _name(task: str) -> str:
    t = TaskContext.get()
    return f"{task}-{t.partitionId():05d}-{t.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def roles(pages: DataFrame, smallest: int) -> DataFrame:
    """(page_id, url, html, sha, payload_bytes, refers_to) of each row of ``pages(page_id, url, html)``.

    Rows stay where they are: only the payloads that repeat are gathered, as their digest, size and
    smallest page_id, and sent to all tasks if they are at most BROADCAST_IDS by count. More are joined in
    SALTS parts, so that a payload of very many pages doesn't meet in one task.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), body.alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    same = rows.where(F.col("payload_bytes") >= smallest).groupBy("sha", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    same = cut(same, "repeated")
    if same.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        joined = rows.join(F.broadcast(same), ["sha", "payload_bytes"], "left")
    else:
        salted = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(salted, ["sha", "payload_bytes", "salt"], "left")
    later = F.col("page_id").isNull() | (F.col("first") < F.col("page_id"))
    return joined.select("page_id", "url", "html", "sha", "payload_bytes", F.when(later, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, smallest: int = 0) -> DataFrame:
    """Write all rows into monolithic archives and return their paths and numbers of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        out = z = None
        path, n, size = "", 0, 0

        def close() -> None:
            out.write(z.flush())
            out.close()
            done.append((path, n))

        for b in batches:
            for page, url, html, sha, full, refers in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None:
                    path, n, size, z = f"{root}/{_name('whole')}.warc.gz", 0, 0, zlib.compressobj(1, wbits=31)
                    out = system.open_output_stream(path, compression=None)
                kind = "response" if refers is None else "revisit"
                url = url.replace("\r", "%0D").replace("\n", "%0A")
                out.write(z.compress(record(page, url, kind, html, base64.b32encode(bytes.fromhex(sha)).decode(), full, refers)))
                n, size = n + 1, size + len(html)
                if size >= ARCHIVE:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64()))], names=["path", "n"])

    return cut(roles(pages, smallest).mapInArrow(run, "path string, n long"), "archives")


INDEX = "path string, number long, offset long, size long"


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``archives(path, n)`` with one member per record and a sidecar index.

    Returns the index: archive path, record number, byte offset and length of its member. Memory holds a
    block and one record. Sidecars are lines of JSON in ``<archive>.idx``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for b in batches:
            for source in b.column(0).to_pylist():
                path = f"{root}/{_name('members')}.warc.gz"
                offsets, sizes, at = [], [], 0
                with system.open_input_stream(source, compression=None) as read, system.open_output_stream(path, compression=None) as out, system.open_output_stream(f"{path}.idx") as side:
                    for head, body in records(inflate(read)):
                        z = zlib.compressobj(6, wbits=31)
                        member = z.compress(head + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()
                        out.write(member)
                        side.write((json.dumps({"id": parse_head(head)["WARC-Record-ID"], "offset": at, "size": len(member)}) + "\n").encode())
                        offsets.append(at)
                        sizes.append(len(member))
                        at += len(member)
                n = len(offsets)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(n), pa.int64()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "number", "offset", "size"])

    # One archive a task: an archive is one stream of bounded size.
    return cut(archives.repartitionByRange(max(1, min(20_000, archives.count())), "path").mapInArrow(run, INDEX), "index")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block_bytes long"


def read(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the indexed archives; a response's payload is checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)

        def number(urn: str) -> int | None:
            digits = urn.removeprefix("<urn:page:").removesuffix(">")
            return int(digits) if digits else None

        for b in batches:
            rows = []
            for path, start, end in zip(*[c.to_pylist() for c in b.columns], strict=True):
                with system.open_input_file(path) as f:
                    f.seek(start)
                    blocks = (f.read(min(BLOCK, end - at)) for at in range(start, end, BLOCK))
                    for head, body in records(inflate(_Stream(blocks))):
                        h = parse_head(head)
                        kind, sha, size = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                        if kind == "response" and (digest(body) != sha or len(body) != size):
                            raise ValueError(f"{path}: payload of {h['WARC-Record-ID']} does not match its digest")
                        rows.append((number(h["WARC-Record-ID"]), h.get("WARC-Target-URI", ""), size, sha, kind, number(h["WARC-Refers-To"]) if kind == "revisit" else None, len(body)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "block_bytes"])

    ranges = index.groupBy("path", F.floor(F.col("number") / RECORDS).alias("block")).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("size")).alias("end")).select("path", "start", "end")
    # The rows are few and small but each stands for a long read: they are dealt out by number.
    many = min(20_000, max(1, index.count() // RECORDS))
    return ranges.repartition(many, "path", "start").mapInArrow(run, READ)


class _Stream:
    def __init__(self, blocks: Iterator[bytes]):
        self.blocks = blocks

    def read(self, _: int) -> bytes:
        return next(self.blocks, b"")


def round_trip(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Write, normalise and read back all rows of ``pages(page_id, url, html)``.

    Of records with equal payloads of at least ``smallest`` bytes the smallest page_id is a response and
    the others revisit it. Null html is the empty payload, null urls are empty. Every row is a record:
    rows that repeat the smallest page_id are responses too, and a row without page_id revisits the
    smallest one that there is. Other columns are ignored. An empty table writes no archive and gives no rows.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    return read(normalise(write(pages, folder, smallest), folder), folder)

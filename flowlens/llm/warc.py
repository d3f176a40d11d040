"""WARC archives as a chunked record table (operator 3).

Writing: pages -> payload digests -> one record per page (``response`` for the
page with the largest id among equal payloads, ``revisit`` for the others) ->
chunk rows (record, chunk number, bytes) -> archive files of gzip members, one
member per record. Reading: archive files -> chunk rows again. A payload is
never one object on either side: the writer compresses it chunk by chunk, the
reader inflates into chunks of bounded size, and each chunk row carries the
running SHA-1 of the payload so far, so the last chunk's digest is that of the
whole payload.

Files: archives lie under ``spark.checkpoint.dir`` (shared by driver and
executors) or a folder the caller names, and are opened through
``pyarrow.fs`` by URI. A write task writes to a name of its own attempt and
returns it in the manifest; a task that is run again writes another file, and
only files of the manifest are read, so a lost executor leaves no half record
in the result. The manifest is checkpointed, so reading never re-runs writes.

Scale: chunks of one record stay in the task that holds the page, files are
closed at ``file_bytes``; reading is one task per file. What is shuffled is
the slim (digest, id, url) table and each distinct payload once per task.

Defined cases: a null payload is an empty payload; payloads of 0 bytes are
equal payloads as any other; a null page id sorts before all ids and may be
the response if no other page has the payload (``refers_to`` is then null);
of repeated page ids with equal payloads one row is the response and the
others revisit that id; an empty table writes no file and reads no record;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import cut, shared_dir

CHUNK_CHARS = 256 * 1024
READ_BYTES = 256 * 1024
FILE_BYTES = 256 * 1024 * 1024
GZIP_LEVEL = 4
COPY_BLOCK = 100_000
CRLF = b"\r\n"

MANIFEST = "file string, records bigint, bytes bigint"
CHUNKS = "record_id string, chunk int, data binary, bytes bigint, sha1 string, last boolean, headers string"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# ---------------------------------------------------------------- records ----


def record_types(pages: DataFrame, page_id: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """One row per page: copy, page_id, url, payload, bytes, sha1 (hex),
    record_type and refers_to.

    Rows are told apart by their data alone, so scans that are split in other
    ways cannot change a type. One aggregate by payload, with a map-side part,
    gives each payload once beside its response (largest page id, then url); the
    other pages are counted by (payload, id, url), without the response itself,
    and written once per count. A payload shared by a third of all pages is one
    row per task before the shuffle.
    """
    base = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    )
    base = base.select("*", F.sha1(F.encode("payload", "UTF-8")).alias("sha1"), F.octet_length("payload").cast("bigint").alias("bytes"))
    # the flags put null ids and null urls first, whatever the values are
    order = F.struct(F.col("page_id").isNotNull().alias("has_id"), "page_id", F.col("url").isNotNull().alias("has_url"), "url")
    best = F.max(order).alias("w")
    responses = base.groupBy("sha1", "bytes").agg(best, F.first("payload").alias("payload"))
    responses = responses.select(
        F.lit(0).cast("bigint").alias("copy"), F.col("w.page_id").alias("page_id"), F.col("w.url").alias("url"), "payload", "sha1", "bytes",
        F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"),
    )
    counted = base.groupBy("sha1", "bytes", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    winners = base.groupBy("sha1", "bytes").agg(best)
    same = F.col("page_id").eqNullSafe(F.col("w.page_id")) & F.col("url").eqNullSafe(F.col("w.url"))
    others = counted.join(winners, ["sha1", "bytes"]).withColumn("n", F.col("n") - same.cast("bigint")).where("n > 0")
    # repeated rows are dealt out in blocks: no list of copies is longer than COPY_BLOCK
    blocks = others.withColumn("from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"), F.lit(COPY_BLOCK).cast("bigint"))))
    copies = F.sequence(F.col("from"), F.least(F.col("n"), F.col("from") + (COPY_BLOCK - 1)))
    revisits = blocks.withColumn("copy", F.explode(copies)).select(
        "copy", "page_id", "url", F.lit("").alias("payload"), "sha1", "bytes",
        F.lit("revisit").alias("record_type"), F.col("w.page_id").alias("refers_to"),
    )
    return responses.unionByName(revisits)


def chunk_rows(records: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Record rows -> chunk rows; chunks of a record are adjacent and in order.
    One pass over a payload cuts all its pieces."""
    pieces = F.regexp_extract_all("payload", F.lit(f"(?s)(.{{1,{int(chunk_chars)}}})"), F.lit(1))
    pieces = F.when(F.col("payload") == "", F.array(F.lit(""))).otherwise(pieces)
    last = F.greatest(F.lit(0), F.expr(f"(char_length(payload) - 1) div {int(chunk_chars)}")).cast("int")
    rows = records.withColumn("last_chunk", last)
    kept = [c for c in rows.columns if c != "payload"]
    return rows.select(*kept, F.posexplode(pieces).alias("chunk", "piece"))


def _header(r, stored: int) -> bytes:
    uid = uuid.UUID(bytes=hashlib.md5(f"{r.page_id}|{r.sha1}|{r.url}|{r.copy}|{r.record_type}".encode()).digest())
    head = [
        b"WARC/1.1",
        f"WARC-Type: {r.record_type}".encode(),
        f"WARC-Record-ID: <urn:uuid:{uid}>".encode(),
        f"WARC-Target-URI: {json.dumps(r.url)[1:-1] if r.url else 'urn:none'}".encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{base32_sha1(r.sha1)}".encode(),
        f"X-Payload-Bytes: {r.bytes}".encode(),
    ]
    if r.page_id is not None and not pd.isna(r.page_id):
        head.append(f"X-Page-ID: {int(r.page_id)}".encode())
    if r.record_type == "revisit":
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if r.refers_to is not None and not pd.isna(r.refers_to):
            head.append(f"X-Refers-To: {int(r.refers_to)}".encode())
    head.append(f"Content-Length: {stored}".encode())
    return CRLF.join(head) + CRLF + CRLF


def write_warc(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES, chunk_chars: int = CHUNK_CHARS, **names) -> DataFrame:
    """Writes the archives; returns the manifest (file, records, bytes)."""
    root = f"{folder or shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = open_fs(root)
        task = TaskContext.get()
        name, out, size, count, deflate, number = "", None, 0, 0, None, 0

        def put(data: bytes) -> None:
            nonlocal size
            out.write(data)
            size += len(data)

        for frame in frames:
            done = []
            for r in frame.itertuples(index=False):
                if r.chunk == 0:
                    if out is not None and size >= file_bytes:
                        out.close()
                        done.append((name, count, size))
                        out = None
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                        out, size, count, number = fs.open_output_stream(open_fs(name)[1], compression=None), 0, 0, number + 1
                    deflate = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    put(deflate.compress(_header(r, r.bytes if r.record_type == "response" else 0)))
                    count += 1
                put(deflate.compress(r.piece.encode("utf-8")))
                if r.chunk == r.last_chunk:
                    put(deflate.compress(CRLF + CRLF) + deflate.flush())
            if done:
                yield pd.DataFrame(done, columns=["file", "records", "bytes"])
        if out is not None:
            out.close()
            yield pd.DataFrame([(name, count, size)], columns=["file", "records", "bytes"])

    return cut(chunk_rows(record_types(pages, **names), chunk_chars).mapInPandas(write, MANIFEST))


# ---------------------------------------------------------------- reading ----


class _Inflater:
    """Bytes of a (multi-member) gzip or plain file, in pieces of bounded size."""

    def __init__(self, stream, read_bytes: int):
        self.stream, self.read_bytes = stream, read_bytes
        self.buffer, self.raw, self.member, self.packed, self.end = bytearray(), b"", None, None, False

    def more(self) -> bool:
        """Adds up to about ``read_bytes`` to the buffer; False at the end."""
        while not self.end:
            if not self.raw:
                self.raw = self.stream.read(self.read_bytes)
                if not self.raw:
                    self.end = True
                    if self.member is not None:
                        raise ValueError("archive ends inside a gzip member")
                    return False
            if self.packed is None:
                self.packed = self.raw[:2] == b"\x1f\x8b"
            if not self.packed:
                self.buffer += self.raw
                self.raw = b""
                return True
            if self.member is None:
                self.member = zlib.decompressobj(31)
            data = self.member.decompress(self.raw, self.read_bytes)
            self.raw = self.member.unconsumed_tail
            if self.member.eof:
                self.raw, self.member = self.member.unused_data, None
            if data:
                self.buffer += data
                return True
        return False

    def until(self, mark: bytes, limit: int) -> bytes | None:
        """Takes bytes up to and including ``mark``; None at a clean end."""
        at = 0
        while (at := self.buffer.find(mark, max(0, at))) < 0:
            at = len(self.buffer) - len(mark)
            if at > limit:
                raise ValueError(f"no record header in {limit} bytes")
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("archive ends inside a record header")
                return None
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """``n`` bytes in pieces of at most ``read_bytes``."""
        while n > 0:
            if not self.buffer and not self.more():
                raise ValueError("archive ends inside a payload")
            piece = bytes(self.buffer[: min(n, self.read_bytes)])
            del self.buffer[: len(piece)]
            n -= len(piece)
            yield piece


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").strip().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_chunks(stream, read_bytes: int = READ_BYTES) -> Iterator[tuple]:
    """Chunk rows of one archive: (record_id, chunk, data, bytes, sha1, last, headers).

    ``bytes`` and ``sha1`` run over the payload up to this chunk.
    """
    src = _Inflater(stream, read_bytes)
    while (block := src.until(CRLF + CRLF, 1 << 20)) is not None:
        if not block.strip():
            continue
        head = parse_headers(block)
        left = int(head["content-length"])
        digest, seen, chunk, headers = hashlib.sha1(), 0, 0, json.dumps(head)
        if left == 0:
            yield head["warc-record-id"], 0, b"", 0, digest.hexdigest(), True, headers
        for piece in src.take(left):
            digest.update(piece)
            seen += len(piece)
            yield head["warc-record-id"], chunk, piece, seen, digest.copy().hexdigest(), seen == left, headers if seen == left else None
            chunk += 1


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file) of the archives in a folder, listed by Spark (contents unread)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select(F.col("path").alias("file"))


def read_warc(files: DataFrame, with_data: bool = True, read_bytes: int = READ_BYTES) -> DataFrame:
    """Archive files -> chunk rows; one task per file, memory bounded by a few
    chunks. ``headers`` (JSON) is on the last chunk of a record. Without
    ``with_data`` the bytes are read and digested but not returned."""
    columns = [c.split()[0] for c in CHUNKS.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file in frame["file"]:
                fs, path = open_fs(file)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for row in read_chunks(stream, read_bytes):
                        rows.append(row if with_data else (*row[:2], None, *row[3:]))
                        held += len(row[2]) + 300
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    # a partition number of its own: left to coalescing, the few bytes of the
    # file list would end up in one task
    spread = files.select("file").repartition(max(1, files.count()))
    return spread.mapInPandas(read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk: page_id, payload_bytes and
    payload_digest (of the full payload; of a revisit as its header says),
    record_type, refers_to, intact (digest and length as the header says)."""
    h = F.from_json("headers", "map<string,string>")
    t = chunks.where("last").withColumn("_h", h)
    said = F.regexp_replace(F.col("_h")["warc-payload-digest"], "^sha1:", "")
    return t.select(
        "record_id",
        F.col("_h")["x-page-id"].cast("bigint").alias("page_id"),
        F.col("_h")["warc-type"].alias("record_type"),
        F.col("_h")["x-payload-bytes"].cast("bigint").alias("payload_bytes"),
        said.alias("payload_digest"),
        F.col("_h")["x-refers-to"].cast("bigint").alias("refers_to"),
        F.col("sha1").alias("stored_sha1"),
        F.col("bytes").alias("stored_bytes"),
    )


def page_records(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the archives, reads them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to per page.

    The digest of a response is the one computed from the bytes read back (the
    job fails if the header says otherwise); a revisit takes the digest its
    header names.
    """
    manifest = write_warc(pages, folder, **options)
    got = records(read_warc(manifest, with_data=False))
    digest = base32_column("stored_sha1")
    broken = (F.col("record_type") == "response") & ((digest != F.col("payload_digest")) | (F.col("stored_bytes") != F.col("payload_bytes")))
    checked = F.when(broken, F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))).cast("string"))
    checked = checked.when(F.col("record_type") == "response", digest).otherwise(F.col("payload_digest"))
    return got.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def base32_column(hex_column: str):
    """Upper-case base32 of a 40-digit hex column (20 bytes: 32 digits of five
    bits, four at a time from 20-bit groups of five hex digits)."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = []
    for group in range(8):
        value = F.conv(F.substring(F.col(hex_column), 5 * group + 1, 5), 16, 10).cast("int")
        for place in range(4):
            five = F.shiftright(value, 15 - 5 * place).bitwiseAND(F.lit(31))
            digits.append(F.substring(F.lit(alphabet), five + 1, F.lit(1)))
    return F.concat(*digits)

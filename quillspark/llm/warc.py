"""WARC archives with an embedded Zstandard dictionary, one compressed frame a record.

Layout of a file (.warc.zst): a skippable frame (magic 0x184D2A5D) that holds the dictionary, then
one frame for each record, compressed with it. The dictionary is trained on the file's own records:
the first ``train_bytes`` of them in the order written (a bound on memory, not on what is archived);
where there are too few to train on, their bytes serve as a raw dictionary. Every record is written.

Of rows with equal payloads (equal SHA-1) of at least ``min_revisit_bytes`` bytes, the row with the
largest page id is a response and the others are revisits of it; rows that repeat that id are all
responses, and so are all rows where no id is known. A revisit has no payload but keeps its length
in the HTTP header and its digest. Null payloads are empty; null urls are left out; other columns
are ignored; an empty table gives no archives.

Each task writes one file under a name of its own in a folder all machines share and reports it in
a manifest; only files of the manifest are read, so tasks may be repeated.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict[str, Any]:
    """The fields of RECORD from one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    page = lambda uri: None if uri == "<urn:page:none>" else int(uri[10:-1])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and len(body) != length:
        raise ValueError("a response is cut short")
    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": page(fields["WARC-Refers-To"]) if revisit else None,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": length, "payload": None if revisit else body,
    }


class Writer:
    """Buffers records until there is enough to train on, then writes the dictionary and all records."""

    def __init__(self, out, dict_bytes: int, train_bytes: int, level: int):
        self.out, self.dict_bytes, self.train_bytes, self.level = out, dict_bytes, train_bytes, level
        self.waiting: list[bytes] = []
        self.size = self.n = self.written = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, data: bytes) -> None:
        self.n += 1
        if self.compressor is None:
            self.waiting.append(data)
            self.size += len(data)
            if self.size < self.train_bytes:
                return
            self._start()
        else:
            self._write(self.compressor.compress(data))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _start(self) -> None:
        try:
            trained = zstandard.train_dictionary(min(self.dict_bytes, max(256, self.size // 10)), self.waiting).as_bytes()
        except zstandard.ZstdError:
            trained = b"".join(self.waiting)[-self.dict_bytes :]
        self._write(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True, write_checksum=True)
        for data in self.waiting:
            self._write(self.compressor.compress(data))
        self.waiting = []

    def close(self) -> None:
        if self.compressor is None:
            self._start()


def read(file: io.IOBase) -> Iterator[bytes]:
    """The records of an archive, one frame after another."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(file.read(size)))
    rest = b""
    while True:
        if not rest and not (rest := file.read(1 << 20)):
            return
        frame, out = decompressor.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := file.read(1 << 20)):
                raise ValueError("the archive ends within a record")
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def resolved(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_revisit_bytes: int) -> DataFrame:
    """Each page with the page it revisits. Only ids and digests are aggregated; AQE splits a digest with many pages in the join."""
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    page = page.withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    last = page.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1").select("sha", "last")
    last = common.materialize(last, "last")  # AQE splits a digest with many pages only between two plain exchanges
    joined = page.join(last, "sha", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, dict_bytes: int = 64 * 1024, train_bytes: int = 4_000_000, level: int = 3) -> DataFrame:
    """Archive ``pages`` under ``folder``; returns the manifest, itself a table there."""
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}.warc.zst"
        out = writer = None
        for b in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None:
                    out = fs.open_output_stream(name)
                    writer = Writer(out, dict_bytes, train_bytes, level)
                writer.add(record(page_id, url, html.encode(), refers_to, refers_to is not None))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [writer.n], "n_bytes": [writer.written]})

    manifest = f"{folder}/manifest"
    with common.dropping_shuffles(spark):
        resolved(pages, id_col, url_col, html_col, min_revisit_bytes).mapInArrow(run, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives of a manifest; responses are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = common.filesystem(folder)
        types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in types.items()], list(types))

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path) as f:
                    for data in read(f):
                        r = parse(data)
                        if r["payload"] is not None and digest(r["payload"]) != r["payload_digest"]:
                            raise ValueError(f"a payload of {path} does not match its digest")
                        if not payloads:
                            r["payload"] = None
                        rows.append(r)
                        size += len(data) * payloads + 200
                        if size > 4_000_000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(spread).mapInArrow(run, RECORD)


def archive_digests(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Archive pages in the shared folder, read the archives back, and describe each record."""
    folder = common.fresh_path(spark, "warc")
    records = read_archives(write(pages, folder, **options), folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 takes 5 hexadecimal digits for 4 characters.
ORACLE = """
WITH page AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM page),
last AS (SELECT hex, max(page_id) AS last, count(*) AS copies FROM hashed WHERE payload_bytes >= 0 GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN copies > 1 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN copies > 1 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM hashed JOIN last USING (hex)
"""

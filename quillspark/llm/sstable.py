"""Token-ID output as sorted-string-table shards.

A shard holds documents in ascending order of their identifier. Its file is a run of data blocks,
then a Bloom filter of the keys, a sparse index with the first key and place of each block, and a
footer of fixed size that says where those two begin:

    block   records, each: shared prefix length, rest length, value length (varints), rest of key, value
    value   ids as little-endian unsigned integers of the footer's width: 2 bytes if the vocabulary's ids fit, else 4
    bloom   number of hash functions (u32), bits
    index   entries, each: key length (varint), key, offset (u64), size (u64)
    footer  offset and size of bloom, offset and size of index (4 x u64), number of records (u64), crc32 of index (u32), width of ids (u8), magic

The first key of a block is written whole (shared length 0), so a lookup asks the Bloom filter,
bisects the index and scans one block. Keys are identifiers as 9 big-endian bytes whose order is
the numeric order: 0x00 alone stands for a null identifier, which sorts first.

Documents are range-partitioned by identifier (rows with equal identifiers stay together, in
order of their text), each task writes one shard under a name of its own and reports it in a
manifest; only shards of the manifest are ever read, so a task that runs twice does no harm.
Null texts are empty (the end id alone); empty tables give an empty manifest; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import common, tokens
from quillspark.llm.bpe import stretches

MAGIC = b"QSST0002"
FOOTER = struct.Struct("<5QIB8s")
BLOCK_BYTES, BITS_PER_KEY, HASHES = 64 * 1024, 10, 7
MANIFEST = "shard int, path string, first_key binary, last_key binary, n_docs long, n_tokens long"


def key_of(identifier: int | None) -> bytes:
    return b"\x00" if identifier is None else b"\x01" + struct.pack(">Q", identifier + 2**63)


def identifier_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - 2**63 if len(key) > 1 else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + k * b) % bits for k in range(HASHES)]


class Writer:
    """Appends records in ascending order of key to a binary stream."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES, width: int = 4):
        self.out, self.block_bytes, self.width = out, block_bytes, width
        self.at = self.n = 0
        self.block = bytearray()
        self.first = self.last = b""
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[bytes] = []

    def add(self, key: bytes, value: bytes) -> None:
        if self.n and key < self.last:
            raise ValueError("keys must not descend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        if not self.n or key != self.last:
            self.hashes.append(key)
        self.last, self.n = key, self.n + 1
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append((self.first, self.at, len(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        bits = max(64, BITS_PER_KEY * len(self.hashes) + 7 & ~7)
        filled = bytearray(bits // 8)
        for key in self.hashes:
            for p in bloom_places(key, bits):
                filled[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<I", HASHES) + bytes(filled)
        index = b"".join(varint(len(k)) + k + struct.pack("<2Q", at, size) for k, at, size in self.index)
        self.out.write(bloom + index + FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), self.n, zlib.crc32(index), self.width, MAGIC))


class Reader:
    """Reads a shard from a random-access file."""

    def __init__(self, file, size: int):
        self.file = file
        bloom_at, bloom_size, index_at, index_size, self.n, crc, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        index = self._read(index_at, index_size)
        if zlib.crc32(index) != crc:
            raise ValueError("the index is damaged")
        self.bloom = self._read(bloom_at, bloom_size)[4:]
        self.keys: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        at = 0
        while at < len(index):
            n, at = read_varint(index, at)
            self.keys.append(index[at : at + n])
            self.places.append(struct.unpack_from("<2Q", index, at + n))
            at += n + 16

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        buf, at, key = self._read(*self.places[k]), 0, b""
        while at < len(buf):
            shared, at = read_varint(buf, at)
            rest, at = read_varint(buf, at)
            size, at = read_varint(buf, at)
            key = key[:shared] + buf[at : at + rest]
            yield key, buf[at + rest : at + rest + size]
            at += rest + size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key: Bloom filter, then binary search of the sparse index, then one block (more if the key repeats)."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, len(self.bloom) * 8)):
            return []
        k = max(0, bisect.bisect_left(self.keys, key) - 1)
        found: list[bytes] = []
        while k < len(self.keys) and self.keys[k] <= key:
            found += [v for x, v in self.block(k) if x == key]
            k += 1
        return found


def packer(width: int):
    """Ids -> little-endian bytes, ``width`` to an id."""
    kind = {2: "H", 4: "I"}[width]
    if sys.byteorder == "little":
        return lambda ids: array(kind, ids).tobytes()
    return lambda ids: struct.pack(f"<{len(ids)}{kind}", *ids)


_PIECES: dict[tuple[str, int], tokens.Pieces] = {}


def encoder(path: str, width: int):
    """Texts -> the bytes of their ids, ``width`` to an id, by the tokenizers library: by pre-token, through a cache, where texts can be split."""
    lib = tokens.load(path)
    pack = packer(width)
    if not isinstance(lib, tokens.ByteLevel):
        return lambda texts: [pack(ids) for ids in lib.encode_many(texts)]
    if (path, width) not in _PIECES:
        _PIECES[path, width] = tokens.Pieces(lib, pack)
    return lambda texts: [b"".join(_PIECES[path, width].of(x)) for x in texts]


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = 2, shards: int | None = None) -> DataFrame:
    """Write ``docs`` as shards under ``folder`` and return the manifest, itself a table there."""
    path = path or tokens.default_path()
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        width = 2 if max(tokens.load(path).model.get_vocab_size() if path.endswith(".json") else tokens.load(path).model.get_piece_size(), (end_id or 0) + 1) <= 1 << 16 else 4
        encode = encoder(path, width)
        tail = b"" if end_id is None else end_id.to_bytes(width, "little")
        shard = TaskContext.get().partitionId()
        fs, root = common.filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        first = last = None
        docs_seen = ids_seen = 0
        out = writer = None
        for whole in batches:
            for b in stretches(whole, 1, 8_000_000):
                for i, ids in zip(b.column(0).to_pylist(), encode(pc.fill_null(b.column(1), "").to_pylist()), strict=True):
                    if writer is None:
                        out = fs.open_output_stream(name)
                        writer = Writer(out, width=width)
                    key = key_of(i)
                    first, last = first if docs_seen else key, key
                    writer.add(key, ids + tail)
                    docs_seen, ids_seen = docs_seen + 1, ids_seen + (len(ids) + len(tail)) // width
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "first_key": [first], "last_key": [last], "n_docs": [docs_seen], "n_tokens": [ids_seen]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(shards, F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"), "text")
    manifest = f"{folder}/manifest"
    with common.dropping_shuffles(spark):
        ordered.mapInArrow(run, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def scan_digests(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every record of the shards, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = common.filesystem(folder)
        for b in batches:
            for r in b.to_pylist():
                ids, starts, sizes, sums = [], [], [], []
                at = r["before"]
                with fs.open_input_file(r["path"]) as f:
                    reader = Reader(f, f.size())
                    for key, value in reader.scan():
                        wide = reader.ids(value)
                        ids.append(identifier_of(key))
                        starts.append(at)
                        sizes.append(len(wide))
                        sums.append(zlib.crc32(wide.tobytes()))
                        at += sizes[-1]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes, sums)], [id_col, "start", "n_tokens", "ids_crc32"])

    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("shard", "path", "n_tokens").withColumn("before", F.coalesce(before, F.lit(0)).cast("long"))
    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("path", "before").repartition(spread).mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, folder: str, identifiers: Iterable[int | None]) -> list[tuple[int | None, list[int]]]:
    """The id arrays of a few identifiers, by binary search: the manifest's key ranges, then each shard's index."""
    fs, _ = common.filesystem(folder)
    found = []
    for i in identifiers:
        key = key_of(i)
        for r in manifest.where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).orderBy("shard").collect():
            with fs.open_input_file(r.path) as f:
                reader = Reader(f, f.size())
                found += [(i, reader.ids(v).tolist()) for v in reader.get(key)]
    return found


def write_and_scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write shards to the shared folder and read them back as digests."""
    folder = common.fresh_path(spark, "sst")
    return scan_digests(write(docs, folder, id_col, text_col, **options), folder, id_col)

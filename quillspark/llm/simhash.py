"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints have 64 bits: a bit is set if it is set in over half of the XXH64 values (seed 42) of a
text's word shingles. They are cut into segments of 23, 23 and 18 bits (the last padded with zeros).
The perfect binary Golay code decodes a 23-bit segment to the one codeword within 3 bits; a segment
3 bits away also takes the five codewords 4 bits away. Two segments that differ in at most 2 bits
then share a codeword. Of 4 differing bits at most one segment has more than 2, so two of the three
segments share codewords: each pair of segments gives keys of two 12-bit codeword indices, texts
meet in a key's bucket, and every meeting is verified by its exact distance.

Equal fingerprints are one node. Buckets hold distinct fingerprints only; one with more than
``bucket`` of them is keyed anew by parts of its segments: of the two that share codewords at most 2 bits differ in each, so
one of three parts of either is equal, and of the other segment at most 4, so one of five parts is. Only what is
still crowded after these three levels is cut into blocks, every two of which meet in a cell of their own; so no task
holds an unbounded bucket and no pair is lost. A bucket reports a spanning forest of its links, not all pairs.

Null and wordless texts have fingerprint zero and link like any other; texts with fewer words than
a shingle are one shingle. Component ids are the smallest id reached; null ids count for none, and a
component of null ids alone has a null one. Repeated rows each give a row. Empty tables give empty
results; other columns are ignored. Ids are numbers (cast to long).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, heavy_values, materialize, salted_join
from quillspark.llm.components import components
from quillspark.llm.windows import mix

#: Generator polynomial of the (23, 12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
MOST = 4
SEED = 42


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, ASCII letters in lower case, joined by one space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[:-size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(begins, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 majority bits as a signed number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(shingle_hashes(x.as_py(), size)) for x in b.column(1)], pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


class Golay:
    """Near codewords of 23-bit words by syndrome."""

    def __init__(self):
        bits = np.arange(2**11, dtype=np.int64)
        self.low = self._syndromes(bits)
        self.high = self._syndromes(np.arange(2**12, dtype=np.int64) << 11)
        leaders: dict[int, list[int]] = {0: [0]}
        for weight in (1, 2, 3, 4):
            for places in combinations(range(23), weight):
                e = sum(1 << p for p in places)
                s = int(self.syndrome(np.array([e]))[0])
                if weight < 4 or leaders[s][0].bit_count() == 3:
                    leaders.setdefault(s, []).append(e)
        self.patterns = np.array([leaders[s] + [-1] * (6 - len(leaders[s])) for s in range(2048)], np.int64)

    @staticmethod
    def _syndromes(words: np.ndarray) -> np.ndarray:
        rest = words.copy()
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
        return rest

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 2047] ^ self.high[words >> 11]

    def indices(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) indices of near codewords, -1 where a word has one only."""
        patterns = self.patterns[self.syndrome(words)]
        return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> 11)


def fuzzy_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned fingerprints."""
    near = [golay.indices(((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64)) for at, bits in SEGMENTS]
    rows, keys = [], []
    for n, (a, b) in enumerate((near[x], near[y]) for x, y in PAIRS):
        both = (a[:, :, None] >= 0) & (b[:, None, :] >= 0)
        key = (n << 24) | (a[:, :, None] << 12) | b[:, None, :]
        rows.append(np.broadcast_to(np.arange(len(fps))[:, None, None], both.shape)[both])
        keys.append(key[both])
    return np.concatenate(rows), np.concatenate(keys)


#: Pairs of segments in the order of their numbers in keys.
PAIRS = tuple(combinations(range(3), 2))


def part_keys(keys: np.ndarray, fps: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): new keys of rows of crowded buckets; their last two bits number the pair of segments, as the first keys' highest do."""
    pair = keys >> 24 if level == 0 else keys & 3
    rows, out = [], []
    for n, (a, b) in enumerate(PAIRS):
        at = np.flatnonzero(pair == n)
        lo, bits = SEGMENTS[(a, b, 3 - a - b)[level]]
        parts = 3 if level < 2 else 5
        edges = [lo + bits * k // parts for k in range(parts + 1)]
        for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
            value = (fps[at] >> np.uint64(x)) & np.uint64((1 << (y - x)) - 1)
            key = mix(mix(keys[at].astype(np.uint64)) ^ (value << np.uint64(8) | np.uint64(k << 4 | level)))
            rows.append(at)
            out.append((key & ~np.uint64(3) | np.uint64(n)).view(np.int64))
    return np.concatenate(rows), np.concatenate(out)


def forest(fps: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what links of at most ``most`` bits connect among distinct fingerprints."""
    left, out = fps, []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            front = queue.pop()
            for x in front:
                close = np.bitwise_count(left ^ x) <= most
                if close.any():
                    out.append((np.full(int(close.sum()), x), left[close]))
                    queue.append(left[close])
                    left = left[~close]
    return out


def bucket_edges(keys: np.ndarray, fps: np.ndarray, most: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all buckets of rows that are sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    out = [e for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True) for e in forest(np.unique(fps[s : s + n]), most)]
    left = np.repeat(starts + sizes, sizes) - np.arange(len(keys)) - 1
    left[np.repeat(sizes > small, sizes)] = 0
    for apart in range(1, small):
        at = np.flatnonzero(left >= apart)
        if not len(at):
            break
        a, b = fps[at], fps[at + apart]
        close = (np.bitwise_count(a ^ b) <= most) & (a != b)
        out.append((a[close], b[close]))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _bucket_mapper(most: int, cap: int | None):
    """Rows (key, fp) sorted by key -> rows (a, b, key): links, or (fp, null, key) where a bucket has more than ``cap``."""

    def emit(a, b, key=None) -> pa.RecordBatch:
        n = len(a)
        arrays = [pa.array(a.view(np.int64)), pa.nulls(n, pa.int64()) if b is None else pa.array(b.view(np.int64)), pa.nulls(n, pa.int64()) if key is None else pa.array(np.full(n, key, np.int64))]
        return pa.RecordBatch.from_arrays(arrays, ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, over = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for b in batches:
            keys = np.concatenate([keys, np.asarray(b.column(0))])
            fps = np.concatenate([fps, np.asarray(b.column(1)).view(np.uint64)])
            if over is not None:
                same = int(np.searchsorted(keys, over, side="right"))
                if same:
                    yield emit(fps[:same], None, over)
                keys, fps = keys[same:], fps[same:]
                if not len(keys):
                    continue
                over = None
            begin = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cap is not None and len(keys) - begin > cap:
                over = keys[-1]
            if begin:
                yield from whole(keys[:begin], fps[:begin])
            if over is not None:
                yield emit(fps[begin:], None, over)
                keys, fps = keys[:0], fps[:0]
            else:
                keys, fps = keys[begin:], fps[begin:]
        if len(keys):
            yield from whole(keys, fps)

    def whole(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if cap is not None:
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(keys)]]))
            for s, n in zip(starts[sizes > cap].tolist(), sizes[sizes > cap].tolist(), strict=True):
                yield emit(fps[s : s + n], None, keys[s])
            fits = np.repeat(sizes <= cap, sizes)
            keys, fps = keys[fits], fps[fits]
        if len(keys):
            yield emit(*bucket_edges(keys, fps, most))

    return run


def links(distinct_fps: DataFrame, most: int = MOST, bucket: int = 4096) -> DataFrame:
    """(a, b): links that connect all fingerprints (column fp, distinct) within ``most`` <= 4 bits of one another."""
    if most > MOST:
        raise ValueError("the keys guarantee links of up to 4 differing bits")
    return candidates(distinct_fps, most, bucket)


def candidates(distinct_fps: DataFrame, most: int, bucket: int = 4096) -> DataFrame:
    """(a, b): links within ``most`` bits among fingerprints that share a key: all there are up to 4 bits, beyond those that share one by chance."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for b in batches:
            fps = np.asarray(b.column(0)).view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                rows, keys = fuzzy_keys(part, golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], ["key", "fp"])

    def keyed_again(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fps = np.asarray(b.column(1)).view(np.uint64)
                rows, keys = part_keys(np.asarray(b.column(0)), fps, level)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows].view(np.int64))], ["key", "fp"])

        return run

    parts = int(distinct_fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met_by_key(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of the buckets, and the rows of crowded ones."""
        sorted_rows = rows.repartition(parts, "key").sortWithinPartitions("key")
        found = materialize(sorted_rows.mapInArrow(_bucket_mapper(most, bucket), "a long, b long, key long"), "links")
        return found.where("b is not null").select("a", "b"), found.where("b is null").select("key", F.col("a").alias("fp"))

    near, over = met_by_key(distinct_fps.select("fp").mapInArrow(keyed, "key long, fp long"))
    for level in range(3):
        if over.isEmpty():
            return near.distinct()
        more, over = met_by_key(over.mapInArrow(keyed_again(level), "key long, fp long"))
        near = near.union(more)
    if over.isEmpty():
        return near.distinct()
    # Every two blocks of an oversized bucket meet in one cell; cells are numbered by (key, lower block, higher block).
    blocks = over.groupBy("key").agg(F.ceil(2 * F.count("*") / F.lit(bucket)).cast("int").alias("blocks"))
    placed = over.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    met = cells.select(cell.alias("key"), "fp").repartition(parts, "key").sortWithinPartitions("key")
    return near.union(met.mapInArrow(_bucket_mapper(most, None), "a long, b long, key long").select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, most: int = MOST, bucket: int = 4096) -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    rows = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "nodes")
    member = components(links(nodes, most, bucket), "a", "b")
    of = materialize(nodes.join(member, nodes.fp == member.node, "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("component")), "members")
    lowest = materialize(of.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "lowest")
    named = salted_join(of.select("fp", "component"), lowest.drop("n"), ["component"], heavy_values(lowest, "component", "n"), F.col("fp"))
    named = materialize(named.select("fp", "component_id"), "components")
    joined = salted_join(rows, named, ["fp"], heavy_values(nodes, "fp", "n"), F.xxhash64("id"))
    discard(nodes, of, lowest)
    return joined.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without all but one document of each group: the one with the smallest id stays, once; rows with a null id stay.

    Rows are told apart by id and text, so of different texts with one id each goes or stays with its own group.
    """
    text = F.col(text_col).cast("string")
    row = F.xxhash64(F.col(id_col).cast("long"), text).alias("row")
    groups = near_duplicates(docs.select(row, text.alias("text")), "row", "text", **options).distinct()
    with_id = docs.where(F.col(id_col).isNotNull())
    rows = with_id.select(row, F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash")).distinct()
    kept = groups.join(rows, "row").groupBy("component_id").agg(F.min(F.struct("id", "fingerprint", "text_hash")).alias("one")).select("one.id", "one.text_hash")
    same = (F.col(id_col).cast("long") == kept.id) & (F.xxhash64(text) == kept.text_hash)
    return with_id.join(kept, same, "left_semi").dropDuplicates([id_col, text_col]).select(docs.columns).union(docs.where(F.col(id_col).isNull()))

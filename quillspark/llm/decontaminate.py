"""Benchmark decontamination by SimHash of item-sized windows.

Texts and items are lower-cased (A-Z) words in shingles of ``size`` words, hashed by XXH64. Every item
of L words is held against every window of L words (of the whole text where it is shorter; an item
of fewer words than a shingle is one shingle, as are its windows). Windows are fingerprinted by prefix sums of bits;
those that hold no shingle of any item of their size have similarity zero with all of them and are left out.
A multi-index cuts the 64 bits into ``blocks``; two fingerprints within ``radius`` agree in some block
up to radius // blocks bits, so each block has a list of the items within that tolerance of each of its values, and the
lists that a window's blocks name hold all items within the radius. Those are candidates. Each is verified by
the exact weighted Jaccard similarity of the shingles: sum of smaller over sum of larger multiplicities, at least
``similarity``. Similar windows may lie beyond the radius, above all those of few different shingles, where a majority
turns easily; windows there that share enough shingles with an item are met exactly too, so no match is lost.

Items are indexed in blocks of at most ``most_items`` items and ``most_bytes`` bytes of text, written to the shared
folder. The texts are read once: a task holds a stretch of texts and one block at a time, so neither the driver nor a
worker holds more as the benchmark grows. Null and wordless texts and items match nothing; null ids are kept as
they are; repeated rows each give rows; repeated items match separately; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.simhash import shingle_hashes

#: Bytes of text that a task matches with one block of items before it loads the next.
STRETCH_BYTES = 32_000_000
PAIRS = "start_word long, n_words long, similarity double"


def n_words(text: str | None) -> int:
    return len((text or "").encode().split())


def window_fingerprints(hashes: np.ndarray, width: int) -> np.ndarray:
    """Majority-bit fingerprints of all runs of ``width`` hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    return np.packbits(2 * (sums[width:] - sums[:-width]) > width, axis=1, bitorder="little").view("<u8").reshape(-1)


def weighted_similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a or b else 0.0


def overlaps(hashes: list[int], counts: Counter, width: int) -> np.ndarray:
    """How many shingles each run of ``width`` hashes shares with an item, each by its smaller multiplicity."""
    have, shared, out = Counter(), 0, []
    for p, x in enumerate(hashes):
        shared += have[x] < counts[x]
        have[x] += 1
        if p >= width - 1:
            out.append(shared)
            y = hashes[p - width + 1]
            have[y] -= 1
            shared -= have[y] < counts[y]
    return np.array(out, np.int64)


class Index:
    """Items of one block and shingle size, by length: fingerprints, multi-index tables and shingle multisets."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int, radius: int, blocks: int):
        self.size, self.radius = size, radius
        self.edges = [round(64 * k / blocks) for k in range(blocks + 1)]
        self.items = [(i, n_words(t), shingle_hashes(t, size)) for i, t in items]
        self.counts = [Counter(h.tolist()) for _, _, h in self.items]
        self.sizes: dict[int, list[int]] = defaultdict(list)
        having: dict[int, list[int]] = defaultdict(list)
        for k, (_, length, hashes) in enumerate(self.items):
            self.sizes[length].append(k)
            for h in set(hashes.tolist()):
                having[h].append(k)
        self.shingles = np.array(sorted(having), np.uint64)
        self.having = [having[h] for h in self.shingles.tolist()]
        self.fps = np.array([window_fingerprints(h, len(h))[0] for _, _, h in self.items], np.uint64)
        self.lists = {length: [self._lists(np.array(ks), lo, hi, radius // blocks) for lo, hi in zip(self.edges, self.edges[1:], strict=False)] for length, ks in self.sizes.items()}

    def _lists(self, items: np.ndarray, lo: int, hi: int, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
        """For each value of a block of bits where its list of items starts, and the lists behind one another."""
        values = np.arange(1 << (hi - lo), dtype=np.uint64)
        own = (self.fps[items] >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        value, item = np.nonzero(np.bitwise_count(values[:, None] ^ own[None, :]) <= tolerance)
        return np.searchsorted(value, np.arange(len(values) + 1)), items[item].astype(np.int32)

    def near(self, fps: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of the items of ``length`` words whose fingerprints lie within the radius, looked up block by block."""
        found = []
        for (starts, items), lo, hi in zip(self.lists[length], self.edges, self.edges[1:], strict=False):
            value = ((fps >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)
            sizes = starts[value + 1] - starts[value]
            window = np.repeat(np.arange(len(fps)), sizes)
            item = items[np.arange(len(window)) + np.repeat(starts[value] - (np.cumsum(sizes) - sizes), sizes)]
            close = np.bitwise_count(fps[window] ^ self.fps[item]) <= self.radius
            found.append(window[close] * len(self.items) + item[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.items), pairs % len(self.items)

    def matches(self, text: str | None, similarity: float) -> list[tuple[int, int, int, float]]:
        """(item id, first word, words, similarity) of the best window, the first of equals, of each matching item."""
        hashes = shingle_hashes(text, self.size)
        if not len(hashes) or not len(self.shingles):
            return []
        place = np.searchsorted(self.shingles, hashes)
        place[place == len(self.shingles)] = 0
        hits = np.flatnonzero(self.shingles[place] == hashes)
        if not len(hits):
            return []
        words = None
        touched: dict[int, list[int]] = defaultdict(list)
        for p in hits.tolist():
            for k in self.having[place[p]]:
                touched[k].append(p)
        out = []
        by_size: dict[int, list[int]] = defaultdict(list)
        for k in touched:
            by_size[self.items[k][1]].append(k)
        for length, ks in by_size.items():
            words = words or n_words(text)
            window = min(length, words)
            width = max(1, window - self.size + 1) if words >= self.size else 1
            spots = np.unique(np.concatenate([touched[k] for k in ks]))
            for group in np.split(spots, np.flatnonzero(np.diff(spots) >= 2 * width) + 1):
                lo, hi = max(0, int(group[0]) - width + 1), min(len(hashes), int(group[-1]) + width)
                part = hashes[lo:hi]
                if len(part) < width:
                    continue
                windows, items = self.near(window_fingerprints(part, width), length)
                # The exact similarity: a bound from the shared shingles first; an item that shares none has none.
                for k in sorted(ks):
                    want = len(self.items[k][2])
                    least = similarity / (1 + similarity) * (width + want) - 1e-9
                    own = np.array([p - lo for p in touched[k] if lo <= p < hi], np.int64)
                    if len(own) < least:
                        continue
                    inside = np.zeros(len(part) + 1, np.int64)
                    inside[own + 1] = 1
                    shared = np.cumsum(inside)
                    may = shared[width:] - shared[:-width] >= least
                    met = windows[items == k]
                    for w in met[may[met]].tolist():
                        s = weighted_similarity(Counter(part[w : w + width].tolist()), self.counts[k])
                        if s >= similarity:
                            out.append((k, lo + w, window, s))
                    may[met] = False
                    if may.any():  # beyond the radius, as windows with few different shingles in other proportions are
                        both = overlaps(part.tolist(), self.counts[k], width)
                        exact = both / (width + want - both)
                        out += [(k, lo + w, window, float(exact[w])) for w in np.flatnonzero(may & (exact >= similarity)).tolist()]
        best: dict[int, tuple[int, int, int, float]] = {}
        for m in sorted(out, key=lambda m: (-m[3], m[1])):
            best.setdefault(m[0], m)
        return [(self.items[k][0], *best[k][1:]) for k in sorted(best)]


class Block:
    """The indexes of a block of items: one for the items that have a whole shingle, one for each smaller length."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int, radius: int, blocks: int):
        by: dict[int, list] = defaultdict(list)
        for i, t in items:
            if n := min(size, n_words(t)):
                by[n].append((i, t))
        self.parts = [Index(part, n, radius, blocks) for n, part in sorted(by.items())]

    def matches(self, text: str | None, similarity: float) -> list[tuple[int, int, int, float]]:
        return [m for part in self.parts for m in part.matches(text, similarity)]


def item_blocks(items: DataFrame, id_col: str, text_col: str, most_items: int, most_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    block, size = [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator(prefetchPartitions=True):
        block.append((r.i, r.t))
        size += len(r.t or "")
        if len(block) >= most_items or size >= most_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def stored(spark, blocks: Iterator[list], size: int, radius: int, parts: int) -> list[str]:
    """Write the index of each block to the shared folder and return the paths."""
    folder = common.fresh_path(spark, "items")
    fs, root = common.filesystem(folder)
    fs.create_dir(root, recursive=True)
    paths = []
    for n, block in enumerate(blocks):
        with fs.open_output_stream(f"{root}/{n:06d}") as f:
            f.write(pickle.dumps(Block(block, size, radius, parts)))
        paths.append(f"{folder}/{n:06d}")
    return paths


_HELD: dict[str, Block] = {}


def held(path: str) -> Block:
    """The index at ``path``; a worker holds the last one."""
    if path not in _HELD:
        _HELD.clear()
        fs, at = common.filesystem(path)
        with fs.open_input_stream(at) as f:
            _HELD[path] = pickle.loads(f.read())
    return _HELD[path]


def together(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches with about ``STRETCH_BYTES`` of text."""
    some, size = [], 0
    for b in batches:
        some.append(b)
        size += b.column(column).nbytes
        if size >= STRETCH_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, similarity: float = 0.8, radius: int = 20, blocks: int = 7, most_items: int = 10_000, most_bytes: int = 16_000_000) -> DataFrame:
    """(id, item id, start_word, n_words, similarity): the best window of each matching pair."""
    paths = stored(docs.sparkSession, item_blocks(items, item_id, item_text, most_items, most_bytes), size, radius, blocks)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in together(batches, 1):
            for path in paths:
                index = held(path)
                for b in some:
                    rows = [(n, *m) for n, x in enumerate(b.column(1)) for m in index.matches(x.as_py(), similarity)]
                    ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                    values = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64()))]
                    yield pa.RecordBatch.from_arrays([ids, *values], [id_col, item_id, "start_word", "n_words", "similarity"])

    return texts.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_id}` long, {PAIRS}")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, similarity: float = 0.8, radius: int = 20, blocks: int = 7, most_items: int = 10_000, most_bytes: int = 16_000_000) -> DataFrame:
    """``docs`` without the rows that match an item, in one pass without a shuffle."""
    paths = stored(docs.sparkSession, item_blocks(items, item_id, item_text, most_items, most_bytes), size, radius, blocks)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in together(batches, at):
            for path in paths:
                index = held(path)
                some = [b.filter(pa.array([not index.matches(x.as_py(), similarity) for x in b.column(at)], pa.bool_())) for b in some]
            yield from some

    return docs.mapInArrow(run, docs.schema)


#: Windows around shared shingles and their weighted similarity; the defaults of ``contaminated``.
ORACLE = r"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
raw AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
item AS (SELECT *, len(ws) AS words, least(5, len(ws)) AS n FROM raw WHERE len(ws) > 0),
want AS (SELECT iid, n, s, count(*) AS c FROM (SELECT iid, n, array_to_string(ws[p + 1:p + n], ' ') AS s FROM (SELECT *, unnest(range(0, words - n + 1)) AS p FROM item)) GROUP BY iid, n, s),
have AS (SELECT rid, n, p, array_to_string(ws[p + 1:p + n], ' ') AS s
         FROM (SELECT rid, ws, n, unnest(range(0, len(ws) - n + 1)) AS p FROM doc, (SELECT DISTINCT n FROM item) WHERE len(ws) >= n)),
hit AS (SELECT rid, iid, p, s, c FROM have JOIN want USING (n, s)),
place AS (SELECT rid, iid, p, least(words, len(doc.ws)) AS size, least(words, len(doc.ws)) - n + 1 AS width, words - n + 1 AS wanted, len(doc.ws) - n + 1 AS room
          FROM (SELECT DISTINCT rid, iid, p FROM hit) JOIN item USING (iid) JOIN doc USING (rid)),
cand AS (SELECT DISTINCT rid, iid, size, width, wanted, unnest(range(greatest(0, p - width + 1), least(p, room - width) + 1)) AS st FROM place),
shared AS (SELECT rid, iid, st, size, width, wanted, s, least(count(*), any_value(c)) AS k
         FROM cand JOIN hit USING (rid, iid) WHERE p >= st AND p < st + width GROUP BY rid, iid, st, size, width, wanted, s),
sim AS (SELECT rid, iid, st, size, CAST(sum(k) AS DOUBLE) / (width + wanted - sum(k)) AS similarity FROM shared GROUP BY rid, iid, st, size, width, wanted),
best AS (SELECT *, row_number() OVER (PARTITION BY rid, iid ORDER BY similarity DESC, st) AS nth FROM sim WHERE similarity >= 0.8)
SELECT doc_id, item_id, CAST(st AS BIGINT) AS start_word, CAST(size AS BIGINT) AS n_words, similarity
FROM best JOIN doc USING (rid) JOIN item USING (iid) WHERE nth = 1
"""

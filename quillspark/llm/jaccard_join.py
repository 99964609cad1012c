"""N-gram Jaccard join: all links of texts whose sets of word shingles have a similarity of ``percent`` or more, and their components.

A set is a sorted array of XXH64 hashes. Two sets of that similarity share one of the first n - ceil(percent * n / 100) + 1
hashes of each, so texts meet under these. A hash that several texts hold is cut into tiles by size: bands of sizes grow by 0.01 more
than linked sizes can differ, so partners stand in one band or in neighbours, and a tile holds a band and the one above it. A tile with
more than ``tile`` rows is cut into blocks, every two of which meet in a cell; no cell holds more, and no pair is lost.

Within a cell hashed bitmap signatures are compared: each bit is the parity of the shingles that hash to it, so two signatures differ
in no more bits than the sets have elements of their own, and the sets share at most half of what their sizes exceed that by. Only
pairs whose bound suffices are met exactly, by intersection of the sorted arrays.

A first round takes from each cell a forest only: pairs that may be linked and are not connected there yet. They are met
exactly, and what their links connect needs no further comparison, so a group of copies costs rows in proportion to its size. The second round
compares all pairs of different components, so components are exact.

Null and wordless texts have an empty set and are linked with nothing: they are their own component. Texts with fewer words than a shingle
have one shingle. Component ids are the least id reached; null ids count for none, and a component of null ids alone has a null one.
Repeated rows each give a row. Empty tables give empty results; other columns are ignored. Ids are numbers (cast to long).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, heavy_values, materialize, salted_join
from quillspark.llm.components import Forest, components
from quillspark.llm.simhash import shingle_hashes
from quillspark.llm.verify import verified

#: Least and most bits of a signature.
BITS = (1024, 65_536)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Ascending distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, size))


def least_shared(n: int, percent: int) -> int:
    """The least number of elements that a set of n shares with any set of that similarity."""
    return -(-percent * n // 100)


def growth(percent: int) -> float:
    """Natural logarithm of how much the sizes of a band grow: by 0.01 more than linked sizes can differ."""
    return float(np.log(100 / percent + 0.01))


def signature(own: np.ndarray, percent: int) -> bytes:
    """Parities of the elements by hash; a power of two of bits, at least as many as the band's sets have elements."""
    band = int(np.log(len(own)) / growth(percent)) if len(own) else 0
    bits = min(BITS[1], max(BITS[0], 2 << int(growth(percent) * (band + 1) / np.log(2))))
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(sigs: list[bytes], size: int) -> np.ndarray:
    """(rows, words): signatures as they are with ``size`` bytes, since a wider one's halves differ in one bit of the hash."""
    out = np.empty((len(sigs), size // 8), np.uint64)
    for k, s in enumerate(sigs):
        x = np.frombuffer(s, np.uint64)
        while len(x) > out.shape[1]:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[k] = x
    return out


def may_link(n: np.ndarray, m: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m elements with signatures ``bits`` apart can be linked: they share at most (n + m - bits) / 2, and
    need 100 * shared >= percent * (n + m - shared)."""
    return (100 + percent) * (n + m - bits) >= 2 * percent * (n + m)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def described(sets: list[np.ndarray], percent: int) -> list[pa.Array]:
    """n, sig and prefix of ascending sets: the size, the signature and the least hashes, of which linked sets share one."""
    prefixes = [s[: len(s) - least_shared(len(s), percent) + 1].view(np.int64) if len(s) else s.view(np.int64) for s in sets]
    return [pa.array(map(len, sets), pa.int64()), pa.array((signature(s, percent) for s in sets), pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]


def text_nodes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(node, digest, h, low, copies, text, n, sig, prefix) of every distinct text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), size) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, *described(sets, percent)], [*b.schema.names, "n", "sig", "prefix"])

    rows = keyed_texts(docs, id_col, text_col).where("text is not null")
    texts = rows.groupBy("digest", "h").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("text").alias("text"))
    made = texts.mapInArrow(run, "digest binary, h long, low long, copies long, text string, n long, sig binary, prefix array<long>").where("n > 0")
    return made.withColumn("node", F.monotonically_increasing_id())


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"), F.xxhash64(text).alias("h"))


def tiles(nodes: DataFrame, percent: int, tile: int) -> DataFrame:
    """(cell, node, n, upper): a row for each tile, or cell of a large tile, that a node stands in with others; upper rows only meet others' lower ones."""
    by_key, by_tile = Window.partitionBy("key"), Window.partitionBy("key", "band")
    keys = nodes.select("node", "n", F.explode("prefix").alias("key"))
    shared = keys.withColumn("m", F.count("*").over(by_key)).where("m > 1")
    band = F.floor(F.log(F.col("n").cast("double")) / growth(percent)).cast("int")
    both = shared.select("key", "node", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("upper")).withColumn("band", band - F.col("upper"))
    lower = F.when(F.col("upper") == 0, F.col("node"))
    held = both.select("*", F.count("*").over(by_tile).alias("m"), F.count(lower).over(by_tile).alias("lower")).where("m > 1 and lower > 0")
    blocks = F.ceil(2 * F.col("m") / F.lit(tile)).cast("int")
    single = F.col("m") <= tile
    own = F.when(single, 0).otherwise(F.pmod(F.xxhash64("node"), blocks)).cast("int")
    cells = held.withColumn("own", own).withColumn("other", F.explode(F.when(single, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))))
    cell = F.xxhash64("key", "band", F.least("own", "other"), F.greatest("own", "other"))
    return cells.select(cell.alias("cell"), "node", "n", "upper")


def bounded_pairs(cell: np.ndarray, n: np.ndarray, group: np.ndarray, upper: np.ndarray, sigs: list[bytes], percent: int, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell, of different groups, whose sizes and signatures allow the similarity; rows come by cell and size. Of a
    ``forest`` what earlier pairs connect is left out."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(cell)]]))
    width = np.repeat(np.minimum.reduceat(np.fromiter(map(len, sigs), np.int64, len(sigs)), starts), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(cell)) - 1
    known = Forest(np.unique(np.stack([np.repeat(starts, sizes), group], axis=1), axis=0, return_inverse=True)[1].reshape(-1))
    for w in np.unique(width).tolist():
        rows = np.flatnonzero((width == w) & (left > 0))
        own = np.flatnonzero(width == w)
        place = np.zeros(len(cell), np.int64)
        place[own] = np.arange(len(own))
        words = folded([sigs[k] for k in own.tolist()], w)
        step = max(1, (16 << 20) // w)
        apart = 1
        while len(rows):
            ahead = rows + apart
            near = 100 * n[rows] >= percent * n[ahead]
            rows, ahead = rows[near], ahead[near]  # what comes later in the cell is larger still
            may = (known.of(rows) != known.of(ahead)) & ~(upper[rows] & upper[ahead])
            for some in range(0, int(may.sum()), step):
                x, y = rows[may][some : some + step], ahead[may][some : some + step]
                for part in (4, w // 8):  # the first words bound the bits from below, too
                    bits = np.bitwise_count(words[place[x], :part] ^ words[place[y], :part]).sum(axis=1, dtype=np.int64)
                    ok = may_link(n[x], n[y], bits, percent)
                    x, y = x[ok], y[ok]
                if len(x):
                    yield x, y
                    if forest:
                        known.connect(x, y)
            apart += 1
            rows = rows[left[rows] >= apart]


def cell_pairs(percent: int, forest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None

        def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not len(t):
                return
            cell, node, n, group, upper = (np.asarray(t[c].combine_chunks()) for c in ("cell", "node", "n", "component", "upper"))
            for x, y in bounded_pairs(cell, n, group, upper == 1, t["sig"].to_pylist(), percent, forest):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], ["a", "b"])

        for b in batches:
            t = pa.Table.from_batches([b])
            waiting = t if waiting is None else pa.concat_tables([waiting, t])
            if not len(waiting):
                continue
            cells = np.asarray(waiting["cell"].combine_chunks())
            begin = int(np.searchsorted(cells, cells[-1]))
            yield from pairs(waiting.slice(0, begin))
            waiting = waiting.slice(begin).combine_chunks()
        if waiting is not None:
            yield from pairs(waiting)

    return run


def open_pairs(held: DataFrame, nodes: DataFrame, member: DataFrame | None, percent: int, forest: bool) -> DataFrame:
    """(a, b): pairs of different components that meet in a cell and may be linked."""
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = held.withColumn("component", F.col("node")) if member is None else held.join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("cell")
    open_ = named if member is None else materialize(named.join(several, "cell", "left_semi"), "open-cells")
    rows = open_.join(nodes.select("node", "sig"), "node").repartition(parts, "cell").sortWithinPartitions("cell", "n")
    out = materialize(rows.select("cell", "node", "n", "upper", "component", "sig").mapInArrow(cell_pairs(percent, forest), "a long, b long").distinct(), "bounded-pairs")
    if member is not None:
        discard(open_)
    return out


def links(nodes: DataFrame, percent: int, tile: int, make: Callable[[str | None], np.ndarray]) -> DataFrame:
    """(a, b): links that connect all nodes (columns node, text, n, sig, prefix) whose similarity suffices; ``make`` gives the set of a text."""
    held = materialize(tiles(nodes, percent, tile), "tiles")
    enough = lambda a, b: linked(a, b, percent)
    first = open_pairs(held, nodes, None, percent, forest=True)
    near = verified(first, nodes, make, enough)
    member = materialize(components(near, "a", "b"), "members")
    pairs = open_pairs(held, nodes, member, percent, forest=False)
    rest = materialize(pairs.join(first, ["a", "b"], "left_anti"), "rest")
    more = verified(rest, nodes, make, enough)
    out = materialize(near.union(more), "links")
    discard(held, first, near, member, pairs, rest, more)
    return out


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, tile: int = 4096) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``."""
    nodes = materialize(text_nodes(docs, id_col, text_col, size, percent), "nodes")
    found = links(nodes, percent, tile, lambda text: shingle_set(text, size))
    member = components(found, "a", "b")
    of = nodes.select("node", "digest", "h", "low", "copies", "n").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = materialize(of.drop("node"), "members")
    lowest = materialize(of.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "lowest")
    named = salted_join(of.select("digest", "h", F.col("n").alias("n_shingles"), "component"), lowest.drop("n"), ["component"], heavy_values(lowest, "component", "n"), F.col("h"))
    named = materialize(named.select("digest", "h", "n_shingles", "component_id"), "components")
    heavy = heavy_values(of.groupBy("h").agg(F.sum("copies").alias("n")), "h", "n")
    rows = keyed_texts(docs, id_col, text_col).withColumn("worded", F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).drop("text")
    joined = salted_join(rows.where("worded"), named, ["digest", "h"], heavy, F.xxhash64("id")).select("id", "n_shingles", "component_id")
    discard(nodes, of, lowest)
    alone = rows.where("not worded").select("id", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    return joined.union(alone).withColumnRenamed("id", id_col)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS item FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON e.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM n JOIN reached r ON r.doc_id = n.doc_id GROUP BY ALL
"""

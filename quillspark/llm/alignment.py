"""Cross-tokenizer alignment, relational: which tokens of two vocabularies cover the same bytes of a text.

A space and the text are cut into stretches where both vocabularies end a token whatever stands around: before a run of
blanks and line breaks that follows a printable ASCII or Latin character. Each distinct stretch is aligned once:

* its tokens of both vocabularies are exploded by position, windowed sums of their lengths are their ends,
* an outer equi-join on stretch and end puts both sides' ends in one order; every end closes one link, since the bytes since the
  end before lie in one token of each side, and the running count of ends that both sides share is the group's number,
* windows carry each end's tokens, and aggregates make the links, their counts and the groups' text.

Documents are dealt into shards of bounded text size; in a shard a document is an array of stretch numbers. A shard meets only
its own stretches' links (a join and a cogroup by shard), so that documents per id pair are counted where each document is whole,
and Spark adds the counts up. Best counts and sums per stretch are joins again, and shards add up their documents' results.

Null and empty texts have no tokens, nor have texts in which the bytes of a stretch's tokens differ from its own (pieces
never lengthen a text, so then the whole text's differ too). Repeated rows each count as a document; null ids are kept. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import tokens
from quillspark.llm.bpe import stretches as slices
from quillspark.llm.common import discard, materialize, setting

#: Printable ASCII and Latin characters, none of which is white space anywhere.
GOOD = "!-~¡-ɏ"
_PLAIN = re.compile(f"[{GOOD} \n]*").fullmatch
_RUNS = re.compile("[ \n]*[^ \n]+|[ \n]+").findall
_CUTS = re.compile(rf"(?<=[{GOOD}])(?=[ \n])").split
SHARD_BYTES = 32_000_000
#: Bits of the second vocabulary's id in a pair of ids.
PAIR_BITS = 24
_B_MASK = (1 << PAIR_BITS) - 1


def stretches(text: str, cuttable: bool = True) -> list[str]:
    """The pieces of a space and the text that are encoded alone."""
    whole = " " + text
    if not cuttable:
        return [whole]
    return _RUNS(whole) if _PLAIN(whole) else _CUTS(whole)


def packed(nums: np.ndarray) -> bytes:
    return zstandard.compress(nums.astype("<i4").tobytes(), 1)


def unpacked(nums: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(nums), "<i4")


class Sides:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = tokens.Library(path_a), tokens.Library(path_b)
        self.a.model.encode_special_tokens = True
        from_symbol = {s: bytes([b]) for b, s in enumerate(tokens.byte_symbols())}
        self.a_bytes = {i: b"".join(from_symbol.get(c, c.encode()) for c in s) for s, i in self.a.model.get_vocab(with_added_tokens=False).items()}
        m = self.b.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = m.piece_to_id("▁")
        normal = [p for i, p in enumerate(pieces) if not m.is_byte(i)]
        self.cuttable = tokens.ByteLevel.fits(path_a) and not any(re.search("[^▁]▁|[\n ]", p) for p in normal) and m.encode("\na")[0] == self.blank

    def stretches(self, text: str) -> list[str]:
        return stretches(text, self.cuttable)

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of stretches in both vocabularies; the second's model adds a space to what it is given."""
        of_b = self.b.encode_many([p[1:] if p.startswith(" ") else p for p in parts])
        # A blank alone is left empty, for which the model adds nothing.
        return self.a.encode_many(parts), [[self.blank] if p == " " else ids if p.startswith(" ") else ids[1:] for p, ids in zip(parts, of_b, strict=True)]


_SIDES: dict[tuple[str, str], Sides] = {}


def sides(path_a: str, path_b: str) -> Sides:
    if (path_a, path_b) not in _SIDES:
        _SIDES[path_a, path_b] = Sides(path_a, path_b)
    return _SIDES[path_a, path_b]


def numbered(docs: DataFrame, id_col: str, text_col: str, cuttable: bool, shard_bytes: int) -> DataFrame:
    """Rows (shard, id, nums) of documents, whose packed arrays number the stretches of their shard, and rows (shard, num, stretch) of each shard's stretches."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        first, made, size = (context.partitionId() if context else 0) << 32, 0, 0
        number: defaultdict[str, int] = defaultdict(count().__next__)
        ids_type = None

        def batch(shard: int, ids: pa.Array, nums: pa.Array, num: pa.Array, stretch: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), shard, np.int64)), ids, nums, num, stretch], ["shard", "id", "nums", "num", "stretch"])

        def dictionary() -> Iterator[pa.RecordBatch]:
            if number:
                n = len(number)
                yield batch(first + made, pa.nulls(n, ids_type), pa.nulls(n, pa.binary()), pa.array(number.values(), pa.int32()), pa.array(number.keys(), pa.string()))

        for whole in batches:
            ids_type = whole.column(0).type
            for b in slices(whole, 1, min(8_000_000, shard_bytes)):
                if size >= shard_bytes:
                    yield from dictionary()
                    number, made, size = defaultdict(count().__next__), made + 1, 0
                size += b.column(1).nbytes
                numbers = number.__getitem__
                nums = [packed(np.fromiter(map(numbers, stretches(t, cuttable)), np.int32)) if t else None for t in b.column(1).to_pylist()]
                yield batch(first + made, b.column(0), pa.array(nums, pa.binary()), pa.nulls(len(b), pa.int32()), pa.nulls(len(b), pa.string()))
        yield from dictionary()

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"shard long, id {id_type}, nums binary, num int, stretch string")


def encoded(distinct: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(stretch, a, a_len, b, b_len) of stretches whose tokens' bytes are their own."""
    schema = pa.schema([("stretch", pa.string()), *((c, pa.list_(pa.int32())) for c in ("a", "a_len", "b", "b_len"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(path_a, path_b)
        for whole in batches:
            for b in slices(whole, 0, 4_000_000):
                rows = []
                parts = b.column(0).to_pylist()
                for part, x, y in zip(parts, *both.encode(parts), strict=True):
                    of_x, of_y = [both.a_bytes[i] for i in x], [both.b_bytes[i] for i in y]
                    if b"".join(of_x) == b"".join(of_y) == part.encode():
                        rows.append((part, x, list(map(len, of_x)), y, list(map(len, of_y))))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return distinct.mapInArrow(run, "stretch string, a array<int>, a_len array<int>, b array<int>, b_len array<int>")


def links(distinct: DataFrame) -> DataFrame:
    """(w, end, g, a, b, a_ends, b_ends): a row for each link of each stretch; ``end`` closes it, groups ``g`` count down."""

    def side(c: str) -> DataFrame:
        token = dealt.select("w", F.posexplode(F.arrays_zip(c, f"{c}_len")).alias("pos", "t")).select("w", "pos", f"t.{c}", F.col(f"t.{c}_len").alias("len"))
        return token.select("w", c, F.sum("len").over(Window.partitionBy("w").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("end"))

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.repartition(parts, "w")
    ends = side("a").join(side("b"), ["w", "end"], "full")
    down = Window.partitionBy("w").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    a_ends, b_ends = F.col("a").isNotNull(), F.col("b").isNotNull()
    return ends.select("w", "end", F.count(F.when(a_ends & b_ends, 1)).over(down).alias("g"), F.last("a", True).over(down).alias("a"), F.last("b", True).over(down).alias("b"), a_ends.alias("a_ends"), b_ends.alias("b_ends"))


def link_lists(found: DataFrame) -> DataFrame:
    """(w, links): the links of every stretch in order, a number each: a's id, b's id, and whether b's token and a's token end there."""
    pair = F.shiftleft(F.col("a").cast("long"), PAIR_BITS).bitwiseOR(F.col("b").cast("long"))
    link = F.shiftleft(pair, 2).bitwiseOR(F.shiftleft(F.col("b_ends").cast("long"), 1)).bitwiseOR(F.col("a_ends").cast("long"))
    return found.groupBy("w").agg(F.transform(F.array_sort(F.collect_list(F.struct("end", link.alias("link")))), lambda x: x["link"]).alias("links"))


class ShardLinks:
    """Links of a shard's stretches by number."""

    def __init__(self, held: pa.Table):
        nums = np.asarray(held["num"]).astype(np.int64) if len(held) else np.empty(0, np.int64)
        column = pa.chunked_array(held["links"].chunks, pa.list_(pa.int64())).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
        offsets = np.asarray(column.offsets).astype(np.int64) if len(held) else np.zeros(1, np.int64)
        self.flat = np.asarray(column.values) if len(held) else np.empty(0, np.int64)
        begin, sizes = offsets[:-1], np.diff(offsets)
        most = int(nums.max()) + 1 if len(nums) else 0
        # Numbers that have no links here are of stretches without tokens.
        self.start, self.size = np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.start[nums], self.size[nums] = begin, sizes
        a, b = self.flat & 1, (self.flat >> 1) & 1
        self.sums = np.zeros((most, 4), np.int64)
        for k, x in enumerate((a, b, a & b, np.ones_like(a))):
            self.sums[nums, k] = np.add.reduceat(x, begin) if len(nums) else 0
        self.texts: list[str | None] = [None] * most
        for num, at, end in zip(nums.tolist(), begin.tolist(), (begin + sizes).tolist(), strict=True):
            self.texts[num] = groups_text(self.flat[at:end].tolist())

    def known(self, nums: np.ndarray) -> bool:
        return bool(len(nums)) and int(nums.max()) < len(self.size) and bool(self.size[nums].all())

    def of(self, nums: np.ndarray) -> np.ndarray:
        size = self.size[nums]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.start[nums] - (ends - size), size)]


def groups_text(links: list[int]) -> str:
    """The groups of a stretch's links: ids of the first vocabulary, a bar, and those of the second."""
    groups, a, b = [], [], []
    for link in links:
        ends = link & 3
        if ends & 1:
            a.append(str(link >> (PAIR_BITS + 2)))
        if ends & 2:
            b.append(str((link >> 2) & _B_MASK))
        if ends == 3:
            groups.append(f"{','.join(a)}|{','.join(b)}")
            a, b = [], []
    return ";".join(groups)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
SUMS = (*COUNTS, "n_best", "count_sum")


def met(docs: pa.Table, held: pa.Table) -> pa.Table:
    """A shard's documents with their counts and the digest of their groups, and rows (pair, n): in how many of them each id pair is linked."""
    links = ShardLinks(held)
    text = links.texts.__getitem__
    n = len(docs)
    sums, digests, nums_of, pairs = np.zeros((n, len(COUNTS)), np.int64), [], [], []
    for row, kept in enumerate(docs["nums"].to_pylist()):
        nums = None if kept is None else unpacked(kept)
        if nums is None or not links.known(nums):
            digests.append("")
            nums_of.append(None)
            continue
        sums[row] = links.sums[nums].sum(axis=0)
        digests.append(hashlib.sha256(";".join(map(text, nums.tolist())).encode()).hexdigest())
        nums_of.append(kept)
        pairs.append(np.unique(links.of(np.unique(nums)) >> 2))
    pair, count_ = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64))
    first = [docs["shard"], docs["id"], pa.array(nums_of, pa.binary()), *(pa.array(sums[:, k]) for k in range(len(COUNTS))), pa.array(digests, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
    names = ["shard", "id", "nums", *COUNTS, "groups_sha256", "pair", "n"]
    rows = pa.table(first, names=names)
    counted = pa.table([*(pa.nulls(len(pair), rows.schema.field(c).type) for c in names[:-2]), pa.array(pair), pa.array(count_)], schema=rows.schema)
    return pa.concat_tables([rows, counted])


def rated(docs: pa.Table, scores: pa.Table) -> pa.Table:
    """A shard's documents with the sums of their stretches' scores."""
    most = 1 + (pc.max(scores["num"]).as_py() if len(scores) else -1)
    table = np.zeros((most, 2), np.int64)
    if len(scores):
        table[np.asarray(scores["num"])] = np.stack([np.asarray(scores["n_best"]), np.asarray(scores["count_sum"])], axis=1)
    sums = np.array([(0, 0) if x is None else table[unpacked(x)].sum(axis=0) for x in docs["nums"].to_pylist()], np.int64).reshape(-1, 2)
    return pa.table([docs["id"], *(docs[c] for c in COUNTS), pa.array(sums[:, 0]), pa.array(sums[:, 1]), docs["groups_sha256"]], names=["id", *SUMS, "groups_sha256"])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``."""
    path_a, path_b = path_a or tokens.default_path(), path_b or tokens.default_path("piece_bpe_32k.model")
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = materialize(numbered(docs, id_col, text_col, sides(path_a, path_b).cuttable, shard_bytes), "numbered", "zstd")
    own = rows.where("num is not null").select("shard", "num", "stretch")
    distinct = materialize(encoded(own.select("stretch").distinct(), path_a, path_b).withColumn("w", F.monotonically_increasing_id()), "stretches", "zstd")
    # A stretch's rows stay where its number puts them, so that the join on (w, end) needs no exchange of its own.
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        known = materialize(link_lists(links(distinct.drop("stretch"))).join(distinct.select("w", "stretch"), "w"), "links", "zstd")
    discard(distinct)

    texts = rows.where("num is null").select("shard", "id", "nums")
    # Written out, so that the shuffles of this join are gone when the shards' links travel.
    of = materialize(own.join(known.select("stretch", "links"), "stretch").select(F.col("shard").alias("of"), "num", "links"), "placed", "zstd")
    schema = f"shard long, id {id_type}, nums binary, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, pair long, n long"
    found = materialize(texts.groupBy("shard").cogroup(of.groupBy("of")).applyInArrow(met, schema), "met", "zstd")
    discard(of)

    pair = F.shiftright("link", 2)
    counts = materialize(found.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", PAIR_BITS)), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("best"))
    scored = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("is_best"))
    # Links of stretches that only texts without tokens hold have no counts and are never asked for.
    sums = known.select("w", F.explode("links").alias("link")).select("w", pair.alias("pair")).join(scored, "pair").groupBy("w").agg(F.sum("is_best").alias("n_best"), F.sum("n").alias("count_sum"))
    scores = materialize(sums.join(known.select("w", "stretch"), "w").drop("w"), "scores", "zstd")
    discard(known)
    done = found.where("pair is null").select("shard", "id", "nums", *COUNTS, "groups_sha256")
    by_num = own.join(scores, "stretch").select(F.col("shard").alias("of"), "num", "n_best", "count_sum")
    out = materialize(done.groupBy("shard").cogroup(by_num.groupBy("of")).applyInArrow(rated, f"id {id_type}, {', '.join(f'{c} long' for c in SUMS)}, groups_sha256 string"), "aligned")
    discard(rows, found, counts, scores)
    return out.withColumnRenamed("id", id_col)

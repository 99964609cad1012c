"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths, in tokens, of frequent pre-tokens: one string array and one
byte array of at most ``max_frequent`` entries, broadcast once and hashed once by each worker, which never changes it.
It is learnt from a random sample of about ``sample_docs`` texts of the whole input. Tier two is each Python
worker's own cache: pre-tokens that tier one lacks are encoded by the library, and the first ``max_cached``
of them are kept. No pre-token is ever shuffled, and the sample only decides what is looked up
where, never a count.

Null texts count as empty; null ids and repeated rows each give their own row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import tokens

CHUNK_BYTES = 2_000_000
_TIERS: dict[str, Tiers] = {}


class Tiers(dict):
    """Tier one as a dictionary; what it lacks is looked up in tier two."""

    def __init__(self, table: tuple[pa.Array, pa.Array], t: tokens.ByteLevel, max_cached: int):
        super().__init__(zip(table[0].to_pylist(), table[1].to_pylist(), strict=True))
        self.cache = tokens.Pieces(t, len, max_cached)

    def __missing__(self, piece: str) -> int:
        return self.cache[piece]

    def count(self, texts: list[str]) -> list[int]:
        return [sum(map(self.__getitem__, self.cache.lib.pretokens(x))) for x in texts]


def frequent_lengths(docs: DataFrame, text_col: str, path: str, sample_docs: int, max_frequent: int, per_doc: int = 256) -> tuple[pa.Array, pa.Array]:
    """The most frequent pre-tokens of a random sample and their lengths; each sampled text sends at most ``per_doc`` entries."""
    nothing = pa.array([], pa.string()), pa.array([], pa.uint8())
    if not tokens.ByteLevel.fits(path):
        return nothing
    n = docs.count()
    if not n:
        return nothing

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens.load(path)
        for b in batches:
            top = [x for text in b.column(0).to_pylist() for x in Counter(t.pretokens(text)).most_common(per_doc)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["piece", "n"])

    texts = docs.select(F.col(text_col).alias("text")).where("text is not null").sample(min(1.0, sample_docs / n), seed=1)
    total: Counter = Counter()
    for row in texts.mapInArrow(tally, "piece string, n long").collect():  # at most per_doc rows for each sampled text
        total[row.piece] += row.n
    pieces = [p for p, _ in total.most_common(max_frequent)]
    t = tokens.load(path)
    table = [(p, len(ids)) for p, ids in zip(pieces, t.encode_many(pieces), strict=True) if len(ids) < 256]
    return pa.array([p for p, _ in table], pa.string()), pa.array([k for _, k in table], pa.uint8())


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512, sample_docs: int = 2000, max_frequent: int = 65_536, max_cached: int = 600_000) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``."""
    path = path or tokens.default_path()
    spark = docs.sparkSession
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, text_col, path, sample_docs, max_frequent))
    id_type = docs.schema[id_col].dataType

    def counted(t: tokens.Library, texts: list[str]) -> list[int]:
        if not isinstance(t, tokens.ByteLevel):
            return [len(x) for x in t.encode_many(texts)]
        if name not in _TIERS:  # a worker that is used again has the tiers of another query
            _TIERS.clear()
            _TIERS[name] = Tiers(shared.value, t, max_cached)
        return _TIERS[name].count(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens.load(path)
        for b in batches:
            col = pc.fill_null(b.column(1), "")
            sizes = pc.binary_length(col.cast(pa.binary())).to_pylist()
            out: list[int] = []
            at = 0
            while at < len(sizes):
                end, size = at, 0
                while end < len(sizes) and (end == at or size + sizes[end] <= CHUNK_BYTES):
                    size += sizes[end]
                    end += 1
                out += counted(t, col.slice(at, end - at).to_pylist())
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.int64()), pa.array([x > limit for x in out], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = f"`{id_col}` {id_type.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)

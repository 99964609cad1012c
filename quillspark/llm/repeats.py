"""Removal of windows that occur elsewhere in a table, as a few joins around a resolver of contexts.

1. Triggers (see windows) give each text rows (near, whole, text, place). Windows can only be equal if
   their triggers' ``near`` hashes are, so rows whose ``near`` occurs once are dropped: a count by ``near``
   (combined map-side) joined back to the rows.
2. Rows are counted by (near, whole), 128 bits of hash that name a context. One copy of every context is cut
   from its text, with its count, and sent to a shard together with all contexts of its ``near``. Contexts of one
   neighbourhood lie near one another there: they are ordered by the first place their ``near`` has.
3. In each shard a resolver (``Unit.repeated``) finds the windows that occur twice or more among the contexts,
   each counted as often as its context occurs. A ``near`` with more than ``most`` contexts is split: the
   windows' starts before the trigger are cut into ever shorter blocks, the context of a block is what its windows
   cover, and blocks meet under a hash of the symbols that all their windows share. Equal ones become one again,
   so at the last level, a single window, each group holds one; every window passes a resolver all the same.
4. What a context repeats is joined back to all places of the context; each text is reduced by its places.

Texts are told apart by 128 bits of hash of id and text: repeated rows repeat each other, so what they
hold of windows goes from all of them. Null texts are empty. Texts shorter than a window stay whole. Null ids give
rows like others, an empty table gives an empty result, other columns are ignored whatever their names.
Keys that hold over a 256th of the rows are salted in joins and combined map-side in aggregates; what is
collected for one text is bounded by that text, and for one group in a shard by ``most``.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import windows
from quillspark.llm.common import discard, heavy_values, materialize, salted_join

#: Symbols that are hashed at once, of one piece of a text, contexts of a shard in memory, and bytes of contexts in a batch.
CHUNK, PIECE, SHARD, BATCH_BYTES = 150_000, 1_000_000, 4_000, 4_000_000
#: Contexts of one ``near`` from which on it is placed by itself, not with its neighbourhood.
CROWD = 64
Symbols = bytes | list[bytes]
CONTEXT = "owner long, spot long, near long, whole long, n long, lo int, hi int, context binary"


@dataclass(frozen=True)
class Unit:
    """What a symbol is, and how windows that occur twice are found.

    ``split`` gives a text's symbols, ``grams`` a hash for each position of symbols behind one another,
    ``pack`` the bytes of a run of symbols and ``unpack`` its symbols. ``repeated(contexts, lo, hi, n)`` takes distinct
    contexts and says for each window of each, in order, whether it occurs twice; context k occurs n[k] times and
    its windows start lo[k] to hi[k] symbols before its trigger.
    """

    shape: windows.Shape
    split: Callable[[str], Symbols]
    grams: Callable[[list[Symbols]], np.ndarray]
    pack: Callable[[Symbols], bytes]
    unpack: Callable[[bytes], Symbols]
    repeated: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select(F.xxhash64("id", "text").alias("key"), F.xxhash64(F.lit(1), "id", "text").alias("tag"), "id", "text")


def trigger_rows(texts: DataFrame, unit: Unit) -> DataFrame:
    """(near, whole, key, tag, place) of all triggers; place packs the trigger's position, lo and hi."""
    shape = unit.shape

    def pieces(b: pa.RecordBatch) -> Iterator[tuple[int, int, Symbols]]:
        for n, x in enumerate(b.column(2)):
            s = unit.split(x.as_py())
            for at in range(0, max(1, len(s) - shape.length + 1), PIECE):
                yield n, at, s if len(s) <= PIECE else s[at : at + PIECE + shape.length - 1]

    def rows(b: pa.RecordBatch, some: list[tuple[int, int, Symbols]]) -> pa.RecordBatch:
        sizes = np.array([len(s) for _, _, s in some], np.int64)
        t = windows.triggers(unit.grams([s for _, _, s in some]), np.cumsum(sizes) - sizes, sizes, shape)
        at = t["at"] + np.array([a for _, a, _ in some], np.int64)[t["text"]]
        of = pa.array(np.array([n for n, _, _ in some], np.int64)[t["text"]])
        place = pa.array(at << 16 | t["lo"] << 8 | t["hi"])
        return pa.RecordBatch.from_arrays([pa.array(t["near"].view(np.int64)), pa.array(t["whole"].view(np.int64)), b.column(0).take(of), b.column(1).take(of), place], ["near", "whole", "key", "tag", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some, size = [], 0
            for piece in pieces(b):
                some.append(piece)
                size += len(piece[2])
                if size >= CHUNK:
                    yield rows(b, some)
                    some, size = [], 0
            if some:
                yield rows(b, some)

    return texts.select("key", "tag", "text").mapInArrow(run, "near long, whole long, key long, tag long, place long")


def unpack_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, place >> 8 & 255, place & 255


def _contexts(owner, spot, near, whole, n, lo, hi, context) -> pa.RecordBatch:
    columns = [*(pa.array(c, pa.int64()) for c in (owner, spot, near, whole, n)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(context, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["owner", "spot", "near", "whole", "n", "lo", "hi", "context"])


def cut_contexts(texts: DataFrame, chosen: DataFrame, unit: Unit) -> DataFrame:
    """The symbols of each chosen place (columns owner, spot, near, whole, n, key, tag, place), from its text."""
    length = unit.shape.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(np.asarray(pc.list_value_length(b.column(1)), np.int64))
            fields = [np.asarray(x) for x in b.column(1).flatten().flatten()]
            at, lo, hi = unpack_place(fields[-1])
            first, done, size = 0, [], 0
            for k, x in enumerate(b.column(0)):
                s = unit.split(x.as_py())
                begin = int(ends[k - 1]) if k else 0
                for y, z in zip((at - lo)[begin : ends[k]].tolist(), (at - hi)[begin : ends[k]].tolist(), strict=True):
                    done.append(unit.pack(s[y : z + length]))
                    size += len(done[-1])
                if size >= BATCH_BYTES or k == b.num_rows - 1:
                    span = slice(first, int(ends[k]))
                    yield _contexts(*(f[span] for f in fields[:-1]), lo[span], hi[span], done)
                    first, done, size = int(ends[k]), [], 0

    wanted = chosen.groupBy("key", "tag").agg(F.collect_list(F.struct("owner", "spot", "near", "whole", "n", "place")).alias("wanted"))
    return texts.select("key", "tag", "text").join(wanted, ["key", "tag"]).dropDuplicates(["key", "tag"]).select("text", "wanted").mapInArrow(run, CONTEXT)


def in_shards(contexts: DataFrame, unit: Unit) -> DataFrame:
    """(near, whole, run): the runs of windows that occur twice among the contexts of a shard; a run packs how far before the trigger its first and last start."""

    def runs(rows: pa.Table) -> pa.RecordBatch:
        near, whole = np.asarray(rows["near"]), np.asarray(rows["whole"])
        first = np.concatenate([[True], (near[1:] != near[:-1]) | (whole[1:] != whole[:-1])])
        rows, near, whole = rows.filter(pa.array(first)), near[first], whole[first]
        lo, hi = np.asarray(rows["lo"]).astype(np.int64), np.asarray(rows["hi"]).astype(np.int64)
        found = unit.repeated(rows["context"].to_pylist(), lo, hi, np.asarray(rows["n"]))
        counts = lo - hi + 1
        c = np.repeat(np.arange(len(lo)), counts)
        k = np.repeat(lo + np.cumsum(counts) - counts, counts) - np.arange(len(c))
        c, k = c[found], k[found]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (k[1:] != k[:-1] - 1)])[: len(c)]
        b = np.flatnonzero(new)
        e = np.concatenate([b[1:], [len(c)]])[: len(b)] - 1
        return pa.RecordBatch.from_arrays([pa.array(near[c[b]]), pa.array(whole[c[b]]), pa.array(k[b] << 8 | k[e], pa.int32())], ["near", "whole", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < SHARD:
                continue
            rows = pa.Table.from_batches(held)
            near = np.asarray(rows["near"])
            cuts = np.flatnonzero(near[1:] != near[:-1]) + 1
            at = 0
            while (k := int(np.searchsorted(cuts, at + SHARD))) < len(cuts):
                yield runs(rows.slice(at, int(cuts[k]) - at))
                at = int(cuts[k])
            rows = rows.slice(at).combine_chunks()
            held, n = rows.to_batches(), rows.num_rows
        if n:
            yield runs(pa.Table.from_batches(held))

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(parts, "owner").sortWithinPartitions("owner", "spot", "near", "whole").mapInArrow(run, "near long, whole long, run int")


def block_contexts(contexts: DataFrame, unit: Unit, level: int) -> DataFrame:
    """(owner, spot, near, whole, n, lo, hi, context, of_near, of_whole): the contexts of the blocks of each context's windows."""
    length, spread = unit.shape.length, unit.shape.spread
    size = -(-spread // (1 << level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for near, whole, n, lo, hi, context in zip(*(b.column(c).to_pylist() for c in ("near", "whole", "n", "lo", "hi", "context")), strict=True):
                s = unit.unpack(context)
                for first in range(hi // size * size, lo + 1, size):
                    last = min(first + size, spread) - 1
                    common = unit.pack(s[lo - first : lo - last + length])
                    low, high = min(lo, last), max(hi, first)
                    part = unit.pack(s[lo - low : lo - high + length])
                    group = xxhash.xxh3_64_intdigest(struct.pack("<qi", near, first) + common) - 2**63
                    name = xxhash.xxh3_64_intdigest(struct.pack("<qii", near, low, high) + part) - 2**63
                    out.append((group, 0, group, name, n, low, high, part, near, whole))
            columns = list(zip(*out, strict=True)) or [[]] * 10
            rows = _contexts(*columns[:8])
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c, pa.int64()) for c in columns[8:])], [*rows.schema.names, "of_near", "of_whole"])

    return contexts.mapInArrow(run, CONTEXT + ", of_near long, of_whole long")


def resolved(quiet: DataFrame, crowd: DataFrame | None, unit: Unit, most: int, spent: list[DataFrame]) -> DataFrame:
    """(near, whole, run) of the contexts of ``quiet`` and of ``crowd``, whose groups are too large for a shard; what it writes joins ``spent``.

    Blocks have names of their own, so all of them go to the shards together; what they repeat goes back to the contexts they are of.
    """
    levels: list[tuple[DataFrame, DataFrame]] = []
    while crowd is not None:
        blocks = materialize(block_contexts(crowd, unit, len(levels) + 1), "blocks")
        parts = blocks.groupBy("near", "whole").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.first(F.struct("owner", "spot", "lo", "hi", "context")).alias("one"))
        parts = materialize(parts.select("one.owner", "one.spot", "near", "whole", "n", "one.lo", "one.hi", "one.context", "rows"), "parts")
        crowded = materialize(parts.groupBy("near").agg(F.count("*").alias("kinds")).where(F.col("kinds") > most), "crowded")
        levels.append((blocks, parts))
        spent += [blocks, parts, crowded]
        rows = parts.drop("rows")
        if crowded.isEmpty() or 1 << len(levels) >= unit.shape.spread:
            quiet, crowd = quiet.union(rows), None
        else:
            quiet = quiet.union(rows.join(crowded, "near", "left_anti").select(quiet.columns))
            crowd = salted_join(rows, crowded.select("near"), ["near"], heavy_values(crowded, "near", "kinds"), F.col("whole"))
    found = materialize(in_shards(quiet, unit), "resolved")
    spent.append(found)
    for blocks, parts in reversed(levels):
        names = blocks.select("near", "whole", "of_near", "of_whole")
        back = salted_join(names, found, ["near", "whole"], heavy_values(parts, "whole", "rows"), F.col("of_whole"))
        found = materialize(found.union(back.select("of_near", "of_whole", "run")), "resolved")
        spent.append(found)
    return found


def repeated_spans(texts: DataFrame, unit: Unit, most: int) -> DataFrame:
    """(key, tag, spans): all places of windows that occur elsewhere; a span packs begin and end, and spans may overlap."""
    rows = trigger_rows(texts, unit)
    # What a join takes from an aggregate is written out first: AQE splits a large key only between two plain exchanges.
    twice = materialize(rows.groupBy("near").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    candidates = salted_join(rows, twice.select("near"), ["near"], heavy_values(twice, "near", "n"), F.xxhash64("key", "place"))
    candidates = materialize(candidates.select("near", "whole", "key", "tag", "place"), "candidates")
    contexts = candidates.groupBy("near", "whole").agg(F.count("*").alias("n"), F.min(F.struct("key", "tag", "place")).alias("one"))
    contexts = materialize(contexts.select("near", "whole", "n", "one.key", "one.tag", "one.place"), "contexts")
    groups = materialize(contexts.groupBy("near").agg(F.count("*").alias("kinds"), F.min(F.struct("key", "place")).alias("home")), "groups")
    alone = F.col("kinds") > CROWD
    homes = groups.select("near", "kinds", F.when(alone, F.col("near")).otherwise(F.col("home.key")).alias("owner"), F.when(alone, 0).otherwise(F.col("home.place")).alias("spot"))
    chosen = salted_join(contexts, homes, ["near"], heavy_values(groups, "near", "kinds"), F.col("whole"))
    spent = [twice, candidates, contexts, groups]
    crowd = chosen.where(F.col("kinds") > most)
    crowd = None if groups.where(F.col("kinds") > most).isEmpty() else cut_contexts(texts, crowd, unit)
    found = resolved(cut_contexts(texts, chosen.where(F.col("kinds") <= most), unit), crowd, unit, most, spent)
    places = salted_join(candidates, found, ["near", "whole"], heavy_values(contexts, "whole", "n"), F.xxhash64("key", "place"))
    at = F.shiftright("place", 16)
    begin, end = at - F.shiftright("run", 8), at - F.col("run").bitwiseAND(255) + unit.shape.length
    places = places.select("key", "tag", (F.shiftleft(begin, 32) + end).alias("span"))
    spans = materialize(places.groupBy("key", "tag").agg(F.collect_set("span").alias("spans")), "spans")
    discard(*spent)
    return spans


def cover(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of packed spans."""
    out: list[tuple[int, int]] = []
    for s in sorted(spans or []):
        b, e = s >> 32, s & 0xFFFFFFFF
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def reduce_texts(docs: DataFrame, unit: Unit, id_col: str, text_col: str, most: int, fields: list[tuple[str, pa.DataType, str]], row: Callable[[Symbols, list[tuple[int, int]]], tuple]) -> DataFrame:
    """``row(symbols, removed runs)`` for every text, with its id first."""
    texts = keyed(docs, id_col, text_col)
    spans = repeated_spans(texts, unit, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(unit.split(t.as_py()), cover(s.as_py())) for t, s in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], f[1]) for k, f in enumerate(fields))], [id_col, *(f[0] for f in fields)])

    schema = ", ".join([f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", *(f"{f[0]} {f[2]}" for f in fields)])
    return texts.join(spans, ["key", "tag"], "left").select("id", "text", "spans").mapInArrow(run, schema)


def kept(symbols: Symbols, removed: list[tuple[int, int]]) -> list[Symbols]:
    at, out = 0, []
    for b, e in removed:
        out.append(symbols[at:b])
        at = e
    return [*out, symbols[at:]]

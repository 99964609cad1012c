"""BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a stretch of a partition lie behind one another in one symbol array.
An index maps each mergeable pair to all its positions. Ranks that have positions are taken in
ascending order: the pair is merged at every position at once, its neighbours' new pairs are
looked up, and their positions join the affected lists. A merge can only create pairs of higher
rank (checked when the vocabulary is loaded), so this order is that of merging each word alone.

Null texts count as empty; null ids and repeated rows each give their own row; an empty table
gives an empty result; other columns are ignored. Around a character whose class differs between
Unicode versions the stretch up to the next plain spaces is encoded by the library.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import tokens

#: Text bytes whose new pre-tokens are encoded together, and cached pre-tokens at which a worker starts anew.
STRETCH_BYTES, MAX_CACHED = 12_000_000, 800_000
NO_RANK = np.int32(2**31 - 1)


class PairRanks:
    """Pair of ids -> (rank, merged id) for arrays: hash tables by level, a level holding what collided above."""

    BITS = 18

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.levels = []
        keys = (pairs[:, 0].astype(np.uint64) << np.uint64(32)) | pairs[:, 1].astype(np.uint64)
        ranks = np.arange(len(keys), dtype=np.int32)
        self.merged = merged.astype(np.int32)
        mult = 0x9E3779B97F4A7C15
        while len(keys):
            slots = self._slots(keys, mult)
            _, first = np.unique(slots, return_index=True)
            table = np.full(1 << self.BITS, np.uint64(2**64 - 1))
            value = np.full(1 << self.BITS, NO_RANK)
            table[slots[first]], value[slots[first]] = keys[first], ranks[first]
            self.levels.append((mult, table, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]
            mult = (mult * 6364136223846793005 + 1442695040888963407) & (2**64 - 1) | 1

    def _slots(self, keys: np.ndarray, mult: int) -> np.ndarray:
        return ((keys * np.uint64(mult)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        out = np.full(len(keys), NO_RANK)
        for mult, table, value in self.levels:
            slots = self._slots(keys, mult)
            hit = table[slots] == keys
            np.copyto(out, value[slots], where=hit)
        return out


class PairIndexBPE:
    """Encodes many byte strings at once; ``words`` must not repeat."""

    def __init__(self, lib: tokens.ByteLevel):
        symbols = tokens.byte_symbols()
        self.byte_id = np.array([lib.vocab[s] for s in symbols], np.int32)
        self.pairs = np.array([(lib.vocab[a], lib.vocab[b]) for a, b in lib.merges], np.int32).reshape(-1, 2)
        merged = np.array([lib.vocab[a + b] for a, b in lib.merges], np.int32)
        made = np.full(max(lib.vocab.values()) + 1, -1, np.int64)
        made[merged] = np.arange(len(merged))
        self.ordered = len(np.unique(merged)) == len(merged) and bool((made[self.pairs].max(axis=1, initial=-1) < np.arange(len(merged))).all())
        self.index = PairRanks(self.pairs, merged)
        from_symbol = {s: b for b, s in enumerate(symbols)}
        self.token_bytes: dict[int, bytes] = {i: bytes(from_symbol[c] for c in s) for s, i in lib.vocab.items() if all(c in from_symbol for c in s)}
        self.token_bytes |= {i: s.encode() for s, i in lib.specials.items()}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words behind one another, number of ids of each word)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        if not n:
            return np.empty(0, np.int32), sizes
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)[sizes > 0]
        nxt[ends - 1] = -1
        prv[np.concatenate([[0], ends[:-1]])] = -1
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(positions: np.ndarray) -> None:
            if not len(positions):
                return
            ranks = self.index.ranks(sym[positions], sym[nxt[positions]])
            known = ranks != NO_RANK
            if not known.any():
                return
            ranks, positions = ranks[known], positions[known]
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(active, r)
                lists[r].append(part)

        enter(np.flatnonzero(nxt >= 0))
        while active:
            rank = heapq.heappop(active)
            parts = lists.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.pairs[rank]
            after = nxt[at]
            live = (sym[at] == a) & (after >= 0)
            live &= sym[after] == b
            at = at[live]
            if a == b and len(at) > 1:
                heads = np.concatenate([[True], nxt[at[:-1]] != at[1:]])
                run = np.maximum.accumulate(np.where(heads, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            then = nxt[gone]
            sym[at], sym[gone] = self.index.merged[rank], -1
            nxt[at] = then
            inner = then >= 0
            prv[then[inner]] = at[inner]
            left = prv[at]
            enter(np.unique(np.concatenate([left[left >= 0], at[inner]])))
        keep = sym >= 0
        return sym[keep], np.bincount(word[keep], minlength=len(words))


class Codec:
    """Whole texts to ids and back, with one growing cache of encoded pre-tokens per worker."""

    def __init__(self, path: str):
        self.lib = tokens.load(path)
        self.bpe = PairIndexBPE(self.lib) if isinstance(self.lib, tokens.ByteLevel) else None
        if self.bpe and not self.bpe.ordered:
            self.bpe = None
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.known = 0
        self.flat = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def learn(self) -> None:
        """Encode the pre-tokens met since the last call."""
        new = list(self.number)[self.known :] if self.known < len(self.number) else []
        if not new:
            return
        other = {k: self.lib.encode(p) for k, p in enumerate(new) if p in self.lib.specials or not self.lib.splittable(p)}
        ids, sizes = self.bpe.encode([b"" if k in other else p.encode() for k, p in enumerate(new)])
        if other:
            places = list(other)
            counts = [len(x) for x in other.values()]
            where = np.concatenate([[0], np.cumsum(sizes)])[places]
            ids = np.insert(ids, np.repeat(where, counts), np.concatenate([np.array(x, np.int64) for x in other.values()]))
            sizes[places] = counts
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.known = len(self.number)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.bpe is None:
            return [np.array(x, np.int32) for x in self.lib.encode_many(texts)]
        if len(self.number) > MAX_CACHED:
            self.clear()
        number = self.number.__getitem__
        pieces = [np.fromiter(map(number, self.lib.pretokens(x)), np.int32) for x in texts]
        self.learn()
        return [self.gather(p) for p in pieces]

    def gather(self, pieces: np.ndarray) -> np.ndarray:
        begin = self.starts[pieces]
        sizes = self.starts[pieces + 1] - begin
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(begin - (ends - sizes), sizes)]

    def decode(self, ids: list[int]) -> str:
        if self.bpe is None:
            return self.lib.decode(ids)
        return b"".join(map(self.bpe.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def stretches(batch: pa.RecordBatch, column: int, most: int = STRETCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def map_encoded(docs: DataFrame, id_col: str, text_col: str, path: str, fields: list[pa.Field], schema: str, row: Callable) -> DataFrame:
    """``row(codec, ids)`` gives the values of ``fields`` for each row of ``docs``; the id comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for b in stretches(whole, 1):
                rows = [row(c, ids) for ids in c.encode(pc.fill_null(b.column(1), "").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields))], [id_col, *(f.name for f in fields)])

    head = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{head}, {schema}")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every whole text."""
    return map_encoded(docs, id_col, text_col, path or tokens.default_path(), [pa.field("ids", pa.list_(pa.int32()))], "ids array<int>", lambda _, ids: (ids,))


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text): the text of every array of ids; a null array gives an empty text."""
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    head = f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}"
    return encoded.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"{head}, text string")


def encode_decode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): ids go through encoding, texts through decoding those ids."""
    names: dict[int, str] = defaultdict(str)

    def row(c: Codec, ids: np.ndarray) -> tuple:
        if not names:
            names.update((i, str(i)) for i in range(70_000))
        listed = ids.tolist()
        shown = ",".join(map(names.__getitem__, listed)) if not len(ids) or int(ids.max()) < 70_000 else ",".join(map(str, listed))
        return len(listed), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(c.decode(listed).encode()).hexdigest()

    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    return map_encoded(docs, id_col, text_col, path or tokens.default_path(), fields, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)

"""Substring deduplication of word windows by compressed FM-indexes, one for each shard.

A shard holds contexts around equal triggers (see repeats). Its words are numbered; the contexts lie behind one
another, each with an end of its own; prefix doubling gives their suffix array and this the
Burrows-Wheeler transform, kept as a wavelet matrix of packed bit vectors with counts by block.

Contexts stream over the index from the right, word by word. A stream carries the interval of the suffixes that begin with
its match, the longest from here on that occurs twice; backward search puts the next word before it. If the longer match
does not occur twice, the match is cut at its end to the next shorter one that more suffixes begin with (the parent
interval, by common lengths of neighbouring suffixes) and the word is tried again. The length at each position
is its matching statistic; positions where it reaches a window report the window. Equal contexts are in the
index once with their number, which counts as so many occurrences, and stream once for all documents that hold them.

Null texts have no words, texts under 35 words stay whole; null ids and repeated rows each give a row (and repeated rows
repeat one another); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quillspark.llm import repeats, windows

SHAPE = windows.WORDS


class Bits:
    """A packed bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words)
        self.before = (np.cumsum(counts, dtype=np.int64) - counts).astype(np.int32)
        self.zeros = len(bits) - int(counts.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)


class WaveletMatrix:
    """Counts of a symbol before a position."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.depth = max(1, int(alphabet - 1).bit_length())
        self.levels: list[Bits] = []
        s = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            s = np.concatenate([s[~bit], s[bit]])
        self.first = np.zeros(alphabet, np.int64)
        self.first = self.walk(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for n, bits in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - n) & 1).astype(bool)
            ones = bits.ones(i)
            i = np.where(one, bits.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.walk(symbol, i) - self.first[symbol]


class FMIndex:
    """Backward search over texts of numbered words (from 1 on), text k counting ``n[k]`` times."""

    def __init__(self, texts: np.ndarray, sizes: np.ndarray, n_words: int, n: np.ndarray | None = None):
        m = len(sizes)
        self.ends = np.cumsum(sizes + 1) - 1
        symbols = np.zeros(len(texts) + m, np.int64)
        inner = np.ones(len(symbols), bool)
        inner[self.ends] = False
        symbols[inner] = texts
        of = np.repeat(np.arange(m), sizes + 1)
        left = self.ends[of] - np.arange(len(symbols)) + 1
        levels: list[np.ndarray] = []
        # Suffixes that are equal to their ends stand in the order of their texts, as ends of their own would have it.
        order = np.argsort(windows.suffix_ranks(symbols, left, levels=levels), kind="stable")
        self.n, self.symbols = len(symbols), symbols
        self.bwt = WaveletMatrix(symbols[order - 1], n_words + 1)
        counts = np.bincount(symbols, minlength=n_words + 1)
        self.start = np.cumsum(counts) - counts
        self.weight = np.concatenate([[0], np.cumsum((np.ones(m, np.int64) if n is None else n)[of[order]])])
        self._neighbours(order, left, levels)

    def _neighbours(self, order: np.ndarray, left: np.ndarray, levels: list[np.ndarray]) -> None:
        """Common lengths of neighbouring suffixes, and where the next smaller one stands on each side."""
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            rank = levels[k]
            same = rank[np.minimum(a + common, self.n - 1)] == rank[np.minimum(b + common, self.n - 1)]
            common += same << k
        common = np.minimum(common, np.minimum(left[a], left[b]) - 1)
        self.common = np.concatenate([[-1], common, [-1]])
        self.before, self.behind = np.arange(-1, self.n), np.arange(1, self.n + 2)
        for smaller in (self.before, self.behind):
            smaller[[0, -1]] = 0, self.n
            open_ = np.arange(1, self.n)
            while len(open_):
                open_ = open_[self.common[smaller[open_]] >= self.common[open_]]
                smaller[open_] = smaller[smaller[open_]]

    def extend(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.start[np.concatenate([word, word])] + self.bwt.rank(np.concatenate([word, word]), np.concatenate([lo, hi]))
        return both[: len(word)], both[len(word) :]

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of the longest shorter match that more suffixes begin with, and its length."""
        left, right = self.common[lo], self.common[hi]
        depth = np.maximum(left, right)
        return np.where(left == depth, self.before[lo], lo), np.where(right == depth, self.behind[hi], hi), np.maximum(depth, 0)

    def matching(self, least: int = 2) -> np.ndarray:
        """For each symbol of the texts how many, from it on in its text, occur ``least`` times or more."""
        statistic = np.zeros(self.n, np.int64)
        first = np.concatenate([[0], self.ends[:-1] + 1])
        at, lo, hi, size = self.ends - 1, np.zeros(len(first), np.int64), np.full(len(first), self.n), np.zeros(len(first), np.int64)
        while True:
            live = at >= first
            if not live.all():
                at, lo, hi, size, first = at[live], lo[live], hi[live], size[live], first[live]
            if not len(at):
                return statistic
            x, y = self.extend(self.symbols[at], lo, hi)
            longer = self.weight[y] - self.weight[x] >= least
            up, down, shorter = self.parent(lo, hi)
            size = np.where(longer, size + 1, shorter)
            # A word that does not occur often enough by itself has no match.
            moved = longer | ((lo == 0) & (hi == self.n))
            size[moved & ~longer] = 0
            statistic[at[moved]] = size[moved]
            lo, hi = np.where(longer, x, up), np.where(longer, y, down)
            at = at - moved


def repeated(contexts: list[bytes], lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each window of each context, in order, occurs twice or more; context k occurs n[k] times."""
    split = [c.split() for c in contexts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    texts = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    index = FMIndex(texts, sizes, len(number), n)
    counts = lo - hi + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return index.matching()[at] >= SHAPE.length


def word_grams(some: list[list[bytes]]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([*(digest(w) for s in some for w in s), *[0] * (2 * SHAPE.length)], np.uint64)


UNIT = repeats.Unit(shape=SHAPE, split=lambda text: text.encode().split(), grams=word_grams, pack=b" ".join, unpack=bytes.split, repeated=repeated)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2_000) -> DataFrame:
    """(id, kept_text, n_words, n_removed, kept_sha256): each text's words, by one space, without those of 35-word windows that also start elsewhere."""
    return _run(docs, id_col, text_col, most, True)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2_000) -> DataFrame:
    """The same without the kept text."""
    return _run(docs, id_col, text_col, most, False)


def _run(docs: DataFrame, id_col: str, text_col: str, most: int, texts: bool) -> DataFrame:
    def row(s: list[bytes], removed: list[tuple[int, int]]) -> tuple:
        words = [w for part in repeats.kept(s, removed) for w in part]
        left = b" ".join(words)
        counts = (len(s), len(s) - len(words), hashlib.sha256(left).hexdigest())
        return (left.decode(), *counts) if texts else counts

    fields = [("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")]
    return repeats.reduce_texts(docs, UNIT, id_col, text_col, most, [("kept_text", pa.string(), "string"), *fields] if texts else fields, row)


ORACLE = r"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT rid, p, array_to_string(ws[p:p + 34], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS p FROM doc WHERE len(ws) >= 35)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS i FROM win JOIN twice USING (k)),
word AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM doc),
rest AS (SELECT rid, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN rest USING (rid)
"""

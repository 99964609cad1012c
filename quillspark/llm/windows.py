"""Windows of a sequence that occur elsewhere: content-defined triggers cut sequences into phrases.

A window is ``length`` consecutive symbols (bytes, or words by hash). Its trigger is the position of
the least rolling hash among its first ``spread`` positions, which depends on the window alone, so
equal windows have their triggers at equal offsets. All windows with one trigger start in one run; the
symbols from the first window's start to the last one's end are the trigger's context.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x ^= x >> np.uint64(27)
    x *= MIX[1]
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 18)
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, BASE, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, pow(BASE, -1, 2**64), np.uint64)]), dtype=np.uint64)
        _POWERS[0] = (up, down)
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


@dataclass(frozen=True)
class Shape:
    """Symbols of a window, of a hashed gram, positions a trigger can have, and grams after a trigger that all its windows hold."""

    length: int
    gram: int
    spread: int

    @property
    def reach(self) -> int:
        return self.length - self.spread + 1 - (self.gram - 1)


BYTES = Shape(200, 8, 96)
WORDS = Shape(35, 1, 17)


def packed(data: np.ndarray) -> np.ndarray:
    """All runs of 8 bytes as numbers, the first byte lowest."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    return x


def byte_grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of 8 bytes."""
    return mix(packed(data))


def suffix_ranks(first: np.ndarray, left: np.ndarray, step: int = 1, levels: list[np.ndarray] | None = None) -> np.ndarray:
    """Ranks of the suffixes of strings that lie behind one another, by prefix doubling; equal suffixes have equal ranks.

    ``first`` orders suffixes by their first ``step`` symbols, ``left`` says how many symbols each has. A rank is the number
    of smaller suffixes, so only suffixes that are still tied are sorted again. The ranks at ``step``, 2 * ``step``, ...
    symbols join ``levels``.
    """
    n = len(first)
    tied = np.argsort(first)
    new = np.concatenate([[True], first[tied][1:] != first[tied][:-1]])[:n]
    rank = np.empty(n, np.int64)
    rank[tied] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        if levels is not None:
            levels.append(rank)
        starts = np.flatnonzero(new)
        if len(starts):
            sizes = np.diff(np.concatenate([starts, [len(tied)]]))
            open_ = (sizes > 1) & (np.maximum.reduceat(left[tied], starts) > step)
            tied = tied[np.repeat(open_, sizes)]
        if not len(tied):
            return rank
        after = np.where(left[tied] > step, rank[np.minimum(tied + step, n - 1)] + 1, 0)
        key = rank[tied] * (n + 2) + after
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        old, places = rank[tied], np.arange(len(tied))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), places, 0))
        finer = old + np.maximum.accumulate(np.where(new, places, 0)) - group
        rank = rank if levels is None else rank.copy()
        rank[tied] = finer
        step *= 2


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        v = np.minimum(v[:-step], v[step:])
        done += step
    return v


class Prefix:
    """Hashes of any run of grams from prefix sums."""

    def __init__(self, grams: np.ndarray):
        up, self.down = powers(len(grams) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(grams * up[:-1], dtype=np.uint64)])

    def run(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.down[begin]


def triggers(grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """Triggers of all windows of texts that lie behind one another.

    ``grams`` holds a hash for each position (positions near a text's end may hold anything), ``starts`` and
    ``sizes`` the texts. Returns arrays: text, at (trigger in its text), lo and hi (how far before it the first
    and last window start), near (hash of the grams that all its windows share), whole (hash of the context).
    """
    fits = sizes >= shape.length
    out = {k: np.empty(0, np.int64) for k in ("text", "at", "lo", "hi")} | {k: np.empty(0, np.uint64) for k in ("near", "whole")}
    if not fits.any():
        return out
    bits = int(len(grams)).bit_length()
    mask = np.uint64((1 << bits) - 1)
    places = np.arange(len(grams), dtype=np.uint64)
    least = sliding_least((mix(grams) & ~mask) | places, shape.spread)
    at = (least & mask).astype(np.int64)
    counts = sizes[fits] - shape.length + 1
    text = np.repeat(np.flatnonzero(fits), counts)
    first = np.repeat(starts[fits], counts)
    p = first + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    a = at[p]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(p)]]) - 1
    a, lo, hi = a[begin], p[begin], p[end]
    prefix = Prefix(grams)
    near = prefix.run(a, a + shape.reach)
    whole = prefix.run(lo, hi + shape.length - shape.gram + 1)
    shift = (a - lo).astype(np.uint64) * np.uint64(1 << 20) + (a - hi).astype(np.uint64)
    return {"text": text[begin], "at": a - first[begin], "lo": a - lo, "hi": a - hi, "near": mix(near), "whole": mix(whole ^ mix(shift + np.uint64(1)))}

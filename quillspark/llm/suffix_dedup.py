"""Suffix-array deduplication of long byte strings by prefix-free parsing.

The contexts of a shard (see repeats) are parsed into phrases: a rolling hash of 8 bytes triggers the end of one
and the start of the next, both of which hold the trigger, so no suffix of a phrase that is longer than a
trigger is a prefix of another's and the order of two suffixes of the text is decided by the suffixes of their
phrases first and by the phrases that follow second.

- The dictionary holds each distinct phrase once; its suffix array ranks all suffixes of phrases, equal ones alike.
- The parse is the text as a sequence of phrase ranks, in the order of the dictionary; its suffix array ranks what follows.
- Both combine to the corpus order of the starts of all windows. Neighbours there that have 200 bytes in common,
  found phrase by phrase and then by bytes, are one window; it occurs as often as the contexts that hold it.

Overlapping contexts and copies cost the dictionary nothing, which is what the method is for.

Null texts are empty, texts under 200 bytes stay whole; null ids and repeated rows each give a row (and repeated rows repeat
one another); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm import repeats, windows

SHAPE = windows.BYTES
#: Bytes of a trigger, and bytes between two of them on average.
TRIGGER, SPACING = 8, 32


def repeated(contexts: list[bytes], lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each window of each context, in order, occurs twice or more; context k occurs n[k] times."""
    length = SHAPE.length
    data = b"".join(contexts)
    flat = np.frombuffer(data + b"\0" * 16, np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    eights = windows.packed(flat)

    # The parse: phrase j is [begin[j], stop[j]), its successor begins at follow[j]; the last of a context ends with it.
    trigger = windows.mix(eights[: len(data)]) & np.uint64(SPACING - 1) == 0
    trigger[(ends[:, None] - np.arange(1, TRIGGER)[None, :]).reshape(-1)] = False
    trigger[starts] = True
    begin = np.flatnonzero(trigger)
    number = np.cumsum(trigger) - 1
    final = number[ends - 1]
    last = np.zeros(len(begin), bool)
    last[final] = True
    follow = np.concatenate([begin[1:], [len(data)]])
    stop = np.where(last, follow, follow + TRIGGER)

    # The dictionary and the ranks of its suffixes.
    found: dict[bytes, int] = {}
    phrase = np.fromiter((found.setdefault(data[x:y], len(found)) for x, y in zip(begin.tolist(), stop.tolist(), strict=True)), np.int64, len(begin))
    phrases = list(found)
    lengths = np.fromiter(map(len, phrases), np.int64, len(phrases))
    heads = np.cumsum(lengths) - lengths
    letters = np.frombuffer(b"".join(phrases) + b"\0" * 8, np.uint8).astype(np.uint64) + np.uint64(1)
    left = np.repeat(heads + lengths, lengths) - np.arange(int(lengths.sum()))
    seven = np.zeros(len(left), np.uint64)
    for k in range(7):
        seven = (seven << np.uint64(9)) | np.where(left > k, letters[k : k + len(left)], 0)
    suffix = windows.suffix_ranks(seven, left, 7)

    # The parse's suffixes, in ranks of phrases.
    rest = np.repeat(final, np.diff(np.concatenate([[-1], final]))) - np.arange(len(begin)) + 1
    parse = windows.suffix_ranks(suffix[heads][phrase], rest)

    # The corpus order of the windows' starts.
    counts = lo - hi + 1
    of = np.repeat(np.arange(len(contexts)), counts)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(of))
    j = number[at]
    own = suffix[heads[phrase[j]] + at - begin[j]]
    then = np.where(last[j], 0, parse[np.minimum(j + 1, len(begin) - 1)] + 1)
    order = np.argsort(own * (len(begin) + 2) + then)

    # Common lengths of neighbours: what is left of equal phrases, then whole phrases, then bytes.
    p, q = order[:-1], order[1:]
    common = np.where(own[p] == own[q], follow[j[p]] - at[p], 0)
    go = np.flatnonzero((common > 0) & (common < length))
    step = 1
    while len(go):
        x, y = j[p[go]] + step, j[q[go]] + step
        equal = phrase[x] == phrase[y]
        go, x = go[equal], x[equal]
        common[go] += follow[x] - begin[x]
        go = go[common[go] < length]
        step += 1
    go = np.flatnonzero(common < length)
    while len(go):
        differ = eights[at[p[go]] + common[go]] ^ eights[at[q[go]] + common[go]]
        more = length - common[go]
        differ = np.where(more < 8, differ << ((8 - np.minimum(more, 8)) * 8).astype(np.uint64), differ)
        go = go[differ == 0]
        common[go] += 8
        go = go[common[go] < length]
    run = np.concatenate([[0], np.cumsum(common < length)])
    often = np.bincount(run, n[of[order]]) >= 2
    out = np.empty(len(of), bool)
    out[order] = often[run]
    return out


UNIT = repeats.Unit(
    shape=SHAPE,
    split=lambda text: text.encode(),
    grams=lambda some: windows.byte_grams(np.frombuffer(b"".join(some) + b"\0" * 2 * SHAPE.length, np.uint8)),
    pack=lambda s: s,
    unpack=lambda s: s,
    repeated=repeated,
)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2_000) -> DataFrame:
    """(id, kept_bytes, n_bytes, n_removed, n_spans, kept_sha256): each text without the bytes of 200-byte strings that also start elsewhere."""
    return _run(docs, id_col, text_col, most, True)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2_000) -> DataFrame:
    """The same without the kept bytes."""
    return _run(docs, id_col, text_col, most, False)


def _run(docs: DataFrame, id_col: str, text_col: str, most: int, texts: bool) -> DataFrame:
    def row(s: bytes, removed: list[tuple[int, int]]) -> tuple:
        left = b"".join(repeats.kept(s, removed))
        counts = (len(s), len(s) - len(left), len(removed), hashlib.sha256(left).hexdigest())
        return (left, *counts) if texts else counts

    fields = [("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")]
    return repeats.reduce_texts(docs, UNIT, id_col, text_col, most, [("kept_bytes", pa.binary(), "binary"), *fields] if texts else fields, row)


#: Bytes as pairs of hexadecimal digits; runs come from the places where coverage starts anew.
ORACLE = """
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT rid, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM doc WHERE length(h) >= 400)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT rid, p FROM win JOIN twice USING (k)),
run AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS g
        FROM (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM hit)),
span AS (SELECT rid, g, min(p) AS b, max(p) + 200 AS e FROM run GROUP BY rid, g),
gap AS (SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY b), 0) AS x, b AS y FROM span
        UNION ALL SELECT rid, max(e), length(any_value(h)) // 2 FROM span JOIN doc USING (rid) GROUP BY rid),
rest AS (SELECT rid, string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x) AS kept FROM gap JOIN doc USING (rid) GROUP BY rid),
counts AS (SELECT rid, sum(e - b) AS n, count(*) AS spans FROM span GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE kept END)) AS kept_sha256
FROM doc LEFT JOIN counts USING (rid) LEFT JOIN rest USING (rid)
"""

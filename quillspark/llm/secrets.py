"""Secret scans: base patterns, and strings whose bytes a primed compressor cannot predict.

Base spans (kinds assign, access, hex) are leftmost, non-overlapping matches of fixed patterns.
Further candidates are strings of at least ``least`` characters in a sensitive context: within
``reach`` characters before or after a word such as password, key or bearer, on any line, outside base
spans. A candidate's novelty is the number of bytes by which it lengthens the Zstandard frame of the
code around it, the compressor being primed with a dictionary of identifiers: the names that most of all
texts themselves hold (``learn_identifiers``) behind a fixed list of usual ones. A name counts if it stands in several texts and is made of
letters in lower case, capitalised or capital parts, so that no secret enters the dictionary. Divided by the candidate's length
the lengthening is near 1 for random strings and small for words, paths and repeated names (the string's own
copies are taken out of the code around it first). Candidates of novelty ``novelty`` or more are
reported as kind novel, whatever characters they are of (digits alone are base spans of kind hex).
Strings that only white space parts from a reported one are candidates too, so the context runs
through the lines of a value. The body of a PEM block with a sensitive label is one candidate, from the first such label
since the block before to its end, of which each line is reported. A string that holds the sensitive word itself is tried without it first,
unless there is another word near.

Spans are in code points, end exclusive. Null texts are empty; null ids and repeated rows each give
their own row; an empty table gives an empty result; other columns are ignored by the scan.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: Runs are maximal, so a least length within the pattern drops the same matches as a later test.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
SENSITIVE = re.compile(r"(?i:passphrase|password|passwd|pwd|secret|token|key|credential|auth|bearer|private|signature|session|cookie|license)", re.ASCII)
STRING = r"[A-Za-z0-9+/_=-]"
PEM = re.compile(r"-----(?:BEGIN ([^\n-]*)-----|END)")
#: A name in code: two or more parts, joined by an underscore or told by capitals.
NAME = r"\b(?:[a-z]{2,14}(?:_[a-z]{2,14}){1,4}|[A-Z]{2,14}(?:_[A-Z]{2,14}){1,4}|[A-Za-z][a-z]{1,14}(?:[A-Z][a-z]{1,14}){1,4}|[a-z]{4,14})\b"
LINE = re.compile(rf"^[\x20\t]*({STRING}+)[\x20\t\r]*$", re.MULTILINE)

_PARTS = "get set is has user name client server config default public private access session request response handler manager service value index count path file line type error message token secret password key auth header param return self this class function import export const static string number object array list map data id url http https www com org net api version test main init load save open close read write".split()
#: Identifiers in snake, camel and constant style, most usual last: Zstandard prefers what is near.
IDENTIFIERS = " ".join(f"{a}_{b} {a}{b.title()} {a.upper()}_{b.upper()}" for a in _PARTS for b in _PARTS[-36:]).encode() + b' "": {}; = \'\' () => \n'


def learn_identifiers(docs: DataFrame, text_col: str = "text", most: int = 4000, least_docs: int = 3, least_share: float = 0.0015) -> bytes:
    """The names that most of all texts hold, the most usual last; those in fewer than ``least_docs`` texts or less than ``least_share`` of the rows do not count."""
    least = max(least_docs, math.ceil(least_share * docs.count()))
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    names = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), 0))).alias("name"))
    # Counts are added up in each task before they are shuffled, and at most ``most`` names are collected.
    top = names.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "name").limit(most).collect()
    return " ".join(r.name for r in reversed(top)).encode()


#: Levels of which the better counts: the first alone leaves over twice as many names made of usual parts novel, the second some long ones.
LEVELS = (3, 12)


class Novelty:
    """Marginal compressed size under a dictionary of the usual identifiers and ``learnt`` ones."""

    def __init__(self, learnt: bytes = b""):
        names = zstandard.ZstdCompressionDict(IDENTIFIERS + learnt, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressors = [zstandard.ZstdCompressor(level=level, dict_data=names, write_content_size=False) for level in LEVELS]

    def marginal(self, around: bytes, candidate: bytes) -> int:
        return min(len(c.compress(around + candidate)) - len(c.compress(around)) for c in self.compressors)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Covered:
    """What some spans cover, for tests by bisection."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.begins, self.ends = [], []
        for b, _, e in spans:
            if self.ends and b <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.begins.append(b)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.begins) and self.begins[at] < end


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: float, least: int, reach: int, around: int, measure: Novelty) -> list[tuple[int, int, int]]:
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    strings = [m.span() for m in re.finditer(f"{STRING}{{{max(least, 1)},}}", text)]
    begins = [b for b, _ in words]
    covered = Covered(base)

    def novel(start: int, end: int) -> bool:
        s = text[start:end]
        if len(s) < least or covered.meets(start, end):
            return False
        code = (text[max(0, start - around) : start] + text[end : end + around]).replace(s, "").encode("utf-8", "replace")
        return measure.marginal(code, s.encode()) >= novelty * len(s)

    def found(start: int, end: int) -> list[tuple[int, int]]:
        """Novel parts of a string for the sensitive words within and near it."""
        first, after = bisect_left(begins, start), bisect_left(begins, end)
        near = (first > 0 and start < words[first - 1][1] + reach) or (after < len(words) and begins[after] - reach < end)
        if near and novel(start, end):
            return [(start, end)]
        if first == after:
            return []
        parts = [(b, e) for b, e in ((start, words[first][0]), (words[first][1], end)) if novel(b, e)]
        return parts or ([(start, end)] if not near and novel(start, end) else [])

    parts = [found(*s) for s in strings]
    # From reported strings on to those that white space alone parts from them, forwards and then backwards.
    for order, step in ((range(1, len(strings)), -1), (range(len(strings) - 2, -1, -1), 1)):
        for k in order:
            if not parts[k] and parts[k + step]:
                (_, left), (right, _) = sorted((strings[k], strings[k + step]))
                if text[left:right].isspace() and novel(*strings[k]):
                    parts[k] = [strings[k]]
    spans = {s for some in parts for s in some}
    opened = None
    for m in PEM.finditer(text):
        if m[1] is not None:
            opened = m.end() if opened is None and SENSITIVE.search(m[1]) else opened
            continue
        if opened is not None:
            lines = [line.span(1) for line in LINE.finditer(text, opened, m.start())]
            body = "".join(text[b:e] for b, e in lines)
            code = (text[max(0, opened - around) : opened] + text[m.start() : m.start() + around]).encode("utf-8", "replace")
            if len(body) >= least and measure.marginal(code, body.encode()) >= novelty * len(body):
                spans.update((b, e) for b, e in lines if not covered.meets(b, e))
        opened = None
    return [(b, 3, e) for b, e in sorted(spans)]


def map_spans(docs: DataFrame, keep: list[str], text_col: str, fields: list[pa.Field], schema: str, row, novelty: float, least: int, reach: int, around: int, learnt: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty(learnt)
        for b in batches:
            rows = []
            for x in b.column(b.num_columns - 1):
                text = x.as_py() or ""
                base = base_spans(text)
                rows.append(row(x.as_py(), base, novel_spans(text, base, novelty, least, reach, around, measure)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields))], [*keep, *(f.name for f in fields)])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"{kept}, {schema}")


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty: float = 0.7, least: int = 16, reach: int = 80, around: int = 512) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""

    def row(_, base, novel):
        counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
        return (*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(base + novel))

    fields = [*(pa.field(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")), pa.field("base_sha256", pa.string()), pa.field("spans", pa.string())]
    return map_spans(docs, [id_col], text_col, fields, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", row, novelty, least, reach, around, learn_identifiers(docs, text_col))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[SECRET]", novelty: float = 0.7, least: int = 16, reach: int = 80, around: int = 512) -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping spans by one) and the length column, if it has one, brought up to date; null texts stay null."""

    def row(text, base, novel):
        spans = sorted(base + novel)
        if not spans:
            return (text,)
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return ("".join([*out, text[at:]]),)

    names = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    others = [c for c in docs.columns if c != text_col]
    plain = docs.select(*(F.col(c).alias(names[c]) for c in docs.columns))
    done = map_spans(plain, [names[c] for c in others], names[text_col], [pa.field("_done", pa.string())], "_done string", row, novelty, least, reach, around, learn_identifiers(docs, text_col))
    out = done.select(*((F.col("_done") if c == text_col else F.col(names[c])).alias(c) for c in docs.columns))
    if length_col in docs.columns and length_col != text_col:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out

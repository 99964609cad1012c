"""Chunkers: one text in, rows (id, chunk_index, text, start_char, end_char, chunk_size, header) out.

Fixed, sliding, sentence and paragraph chunks are Column expressions; strategies whose boundaries
depend on what came before (recursive, code, markdown, code files, adaptive) run in Arrow batches.
Blank texts have no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import sentences, strip, words

FENCE = re.compile(r"```(?:\w+)?\s*(.*?)```", re.S)
Piece = tuple[int, int, str | None]


def _steps(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows: one exists only if the window before it ended before the text did."""
    step = size - (overlap if overlap < size else size // 2)
    return F.sequence(F.lit(0), F.greatest(F.lit(0), n - (size - step) - 1), F.lit(step))


def fixed(df: DataFrame, id_col: str, text_col: str, size: int = 800, overlap: int = 150) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(id_col, text.alias("_t")).where(F.length(strip(F.col("_t"))) > 0)
    rows = rows.select(id_col, "_t", F.posexplode(_steps(F.length("_t"), size, overlap)).alias("chunk_index", "start_char"))
    raw = F.substring("_t", F.col("start_char") + 1, F.lit(size))
    return rows.select(id_col, F.col("chunk_index").cast("long"), strip(raw).alias("text"), F.col("start_char").cast("long"), F.least(F.length("_t"), F.col("start_char") + size).cast("long").alias("end_char"), F.length(raw).cast("long").alias("chunk_size"), F.lit(None).cast("string").alias("header"))


def _packed(df: DataFrame, id_col: str, parts: Column, per: int, joiner: str) -> DataFrame:
    """Runs of ``per`` parts, joined."""
    rows = df.select(id_col, parts.alias("_p")).where(F.size("_p") > 0)
    n = F.ceil(F.size("_p") / F.lit(per)).cast("int")
    rows = rows.select(id_col, "_p", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    text = F.array_join(F.slice("_p", F.col("chunk_index") * per + 1, per), joiner)
    null = F.lit(None).cast("long")
    return rows.select(id_col, F.col("chunk_index").cast("long"), text.alias("text"), null.alias("start_char"), null.alias("end_char"), F.length(text).cast("long").alias("chunk_size"), F.lit(None).cast("string").alias("header"))


def by_sentence(df: DataFrame, id_col: str, text_col: str, size: int = 5, overlap: int = 0) -> DataFrame:
    """``size`` counts sentences."""
    return _packed(df, id_col, sentences(text_col), size, " ")


def by_paragraph(df: DataFrame, id_col: str, text_col: str, size: int = 1, overlap: int = 0) -> DataFrame:
    """``size`` counts paragraphs, which blank lines part."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n\s*\n"), strip), lambda p: p != "")
    return _packed(df, id_col, parts, size, "\n\n")


def sliding_tokens(df: DataFrame, id_col: str, text_col: str, size: int = 100, overlap: int = 20) -> DataFrame:
    """Windows of words."""
    rows = df.select(id_col, words(text_col).alias("_w")).where(F.size("_w") > 0)
    rows = rows.select(id_col, "_w", F.posexplode(_steps(F.size("_w"), size, overlap)).alias("chunk_index", "start_char"))
    text = F.array_join(F.slice("_w", F.col("start_char") + 1, size), " ")
    return rows.select(id_col, F.col("chunk_index").cast("long"), text.alias("text"), F.col("start_char").cast("long"), F.least(F.size("_w"), F.col("start_char") + size).cast("long").alias("end_char"), F.length(text).cast("long").alias("chunk_size"), F.lit(None).cast("string").alias("header"))


# --- boundaries that depend on what came before


def optimal_break(text: str, start: int, end: int) -> int:
    """The best place to end a chunk: paragraph, sentence, comma or space, each only beyond a part of the chunk."""
    if end >= len(text):
        return len(text)
    span = end - start
    for marks, part in ((["\n\n"], 0.3), ([". ", "! ", "? ", ".\n"], 0.5), ([", ", "; "], 0.5), ([" "], 0.7)):
        found = max(text.rfind(m, start + int(span * part), end) + len(m) if text.rfind(m, start + int(span * part), end) >= 0 else -1 for m in marks)
        if found > start:
            return found
    return end


def recursive_pieces(text: str, size: int, overlap: int) -> Iterator[Piece]:
    """Windows of ``size`` characters that end at the best break."""
    start = 0
    while start < len(text):
        end = optimal_break(text, start, min(len(text), start + size))
        yield start, end, None
        if end >= len(text):
            return
        start = max(start + 1, end - overlap)


def code_pieces(text: str, size: int, overlap: int) -> Iterator[Piece]:
    """As recursive, but fenced blocks stay whole."""
    fences = [m.span() for m in FENCE.finditer(text)]
    if not fences:
        yield from recursive_pieces(text, size, overlap)
        return
    within = lambda p: next((f for f in fences if f[0] < p < f[1]), None)
    start = 0
    while start < len(text):
        end = min(len(text), start + size)
        if fence := within(end):
            end = fence[1] if fence[0] <= start or fence[1] - start <= 2 * size else fence[0]
        elif end < len(text):
            cut = optimal_break(text, start, end)
            end = cut if not within(cut) else end
        end = max(end, start + 1)
        yield start, end, None
        if end >= len(text):
            return
        back = end - overlap
        if fence := within(back):
            back = fence[0] if fence[0] > start else end
        start = back if back > start else end - min(overlap // 2, end - start - 1)


def markdown_pieces(text: str, size: int, overlap: int) -> Iterator[Piece]:
    """Sections by # headers outside fences; what overflows is split as code-aware text."""
    at, begin, header, fenced = 0, 0, "root", False
    cuts: list[tuple[int, int, str]] = []
    for line in text.split("\n"):
        if line.strip().startswith("```"):
            fenced = not fenced
        elif not fenced and (m := re.match(r"#{1,6}\s+(.*)", line)):
            if at > begin:
                cuts.append((begin, at, header))
            begin, header = at, m[1].strip()
        at += len(line) + 1
    cuts.append((begin, len(text), header))
    for b, e, h in cuts:
        for s, t, _ in code_pieces(text[b:e], size, overlap):
            yield b + s, b + t, h


# How functions and classes start, by language.
FUNCTION_START = {
    "python": r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)",
    "javascript": r"^\s*(?:export\s+)?(?:async\s+)?(?:function|class)\s+(\w+)|^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(",
    "typescript": r"^\s*(?:export\s+)?(?:async\s+)?(?:function|class|interface)\s+(\w+)",
    "java": r"^\s*(?:public|private|protected|static|final|\s)*(?:class|interface|enum|[\w<>\[\]]+)\s+(\w+)\s*(?:\(|\{)",
    "go": r"^\s*(?:func|type)\s+(?:\([^)]*\)\s*)?(\w+)",
    "rust": r"^\s*(?:pub\s+)?(?:fn|struct|enum|trait|impl)\s+(\w+)",
    "cpp": r"^\s*(?:class|struct|[\w:<>*&]+)\s+(\w+)\s*(?:\(|\{)",
}


def code_file_pieces(text: str, size: int, overlap: int, language: str = "python") -> Iterator[Piece]:
    """Starts at functions and classes that are not indented; long runs are cut at line ends."""
    starts = re.compile(FUNCTION_START[language])
    at = begin = 0
    name: str | None = None
    for line in text.splitlines(keepends=True):
        m = starts.match(line)
        top = m is not None and not line[:1].isspace()
        if at > begin and (top or (name is None and at + len(line) - begin > size)):
            yield begin, at, name
            begin = at
        if top:
            name = next((g for g in m.groups() if g), None)
        elif line.strip() and not line[:1].isspace() and name is not None and not m:
            if at > begin:
                yield begin, at, name
                begin = at
            name = None
        at += len(line)
    if at > begin:
        yield begin, at, name


def adaptive_pieces(text: str, size: int, overlap: int) -> Iterator[Piece]:
    """Markdown where there are headers, code-aware where there are fences, else recursive."""
    if re.search(r"(?m)^#{1,6}\s", text):
        return markdown_pieces(text, size, overlap)
    return code_pieces(text, size, overlap) if "```" in text else recursive_pieces(text, size, overlap)


def by_pieces(pieces: Callable[[str, int, int], Iterator[Piece]]) -> Callable[..., DataFrame]:
    def chunk(df: DataFrame, id_col: str, text_col: str, size: int = 800, overlap: int = 150) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A few texts at a time: their chunks, which overlap, are held before they are handed on.
            for b in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):
                out = []
                for n, x in enumerate(b.column(1)):
                    t = x.as_py() or ""
                    if t.strip():
                        out += [(n, k, t[s:e].strip(), s, e, e - s, h) for k, (s, e, h) in enumerate(p for p in pieces(t, size, overlap) if t[p[0] : p[1]].strip())]
                cols = list(zip(*out, strict=True)) or [[]] * 7
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(arrays[0]), *arrays[1:]], [id_col, "chunk_index", "text", "start_char", "end_char", "chunk_size", "header"])

        schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, chunk_index long, text string, start_char long, end_char long, chunk_size long, header string"
        return df.select(id_col, F.col(text_col)).mapInArrow(run, schema)

    return chunk


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "fixed": fixed, "semantic": fixed, "sentence": by_sentence, "paragraph": by_paragraph, "sliding": sliding_tokens,
    "recursive": by_pieces(recursive_pieces), "code": by_pieces(code_pieces), "markdown": by_pieces(markdown_pieces),
    "code_file": by_pieces(code_file_pieces), "adaptive": by_pieces(adaptive_pieces),
}


def chunk(df: DataFrame, strategy: str = "recursive", id_col: str = "doc_id", text_col: str = "text", size: int = 800, overlap: int = 150) -> DataFrame:
    """Chunks by a strategy's name."""
    return STRATEGIES[strategy](df, id_col, text_col, size, overlap)


# --- chunk reports


def stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    n = F.length(text)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return chunks.agg(F.count("*").alias("total_chunks"), zero(F.avg(n)).cast("double").alias("avg_size"), zero(F.min(n)).cast("long").alias("min_size"), zero(F.max(n)).cast("long").alias("max_size"), zero(F.sum(n)).cast("long").alias("total_chars"), zero(F.stddev_pop(n)).cast("double").alias("std_size"))


def overlaps(chunks: DataFrame, id_col: str, overlap: int, pairs: int = 5) -> DataFrame:
    """For the first pairs of neighbours: whether the end of a chunk lies in the beginning of the next."""
    w = Window.partitionBy(id_col).orderBy("chunk_index")
    rows = chunks.withColumn("next", F.lead("text").over(w)).where(F.col("next").isNotNull() & (F.col("chunk_index") < pairs))
    tail, head = F.substring("text", F.lit(-(overlap // 2)), F.lit(overlap)), F.substring("next", F.lit(1), F.lit(overlap * 2))
    return rows.select(id_col, "chunk_index", F.contains(head, tail).alias("overlaps"))


def odd_fences(_: object = None) -> Column:
    """Whether a chunk (column text) has an odd number of fences."""
    return F.regexp_count("text", F.lit("```")) % 2 == 1


def fences(text: Column | str) -> Column:
    """(language, content) of fenced blocks; no language counts as text."""
    c = F.col(text) if isinstance(text, str) else text
    heads = F.regexp_extract_all(c, F.lit(r"(?s)```(\w*)\s*(.*?)```"), 1)
    bodies = F.regexp_extract_all(c, F.lit(r"(?s)```(\w*)\s*(.*?)```"), 2)
    return F.zip_with(heads, bodies, lambda h, b: F.struct(F.when(h == "", "text").otherwise(h).alias("language"), b.alias("content")))

"""Sources: files by suffix, CSV rendering and inference, HTML, benchmark and fine-tuning sets; sinks beside them."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from html import escape
from html.parser import HTMLParser
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillspark.functions.text import bounded

SUFFIXES = ["pdf", "docx", "txt", "html", "htm", "md", "markdown", "csv", "json"]
DELIMITERS = [",", ";", "\t", "|", ":", " "]


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def validated(files: DataFrame, path: str = "path", length: str = "length", most_mb: int = 100) -> DataFrame:
    """``files`` with error_code: empty, too large, unsupported, or null."""
    code = F.when(F.col(length) == 0, "EMPTY_FILE").when(F.col(length) > most_mb * 1024 * 1024, "FILE_TOO_LARGE").when(~suffix(path).isin(SUFFIXES), "UNSUPPORTED_TYPE")
    return files.withColumn("error_code", code)


def read_files(spark: SparkSession, folder: str, glob: str = "*", most_mb: int = 100) -> tuple[DataFrame, DataFrame]:
    """(texts, errors) of a folder: decoded contents by suffix, and the files that were turned away."""
    files = validated(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder), most_mb=most_mb)
    good = files.where("error_code IS NULL")
    texts = good.where(~suffix("path").isin("pdf", "docx")).select("path", suffix("path").alias("file_type"), F.decode("content", "UTF-8").alias("content"), "length")
    needs_parser = good.where(suffix("path").isin("pdf", "docx")).withColumn("error_code", F.lit("PARSER_NOT_INSTALLED"))
    return texts, files.where("error_code IS NOT NULL").unionByName(needs_parser).select("path", "length", "error_code")


def delimiter_counts(text: Column | str, head: int = 5000) -> Column:
    """Map of candidate delimiters to their counts in the beginning of a text."""
    t = F.substring(F.col(text) if isinstance(text, str) else text, 1, head)
    return F.create_map(*(x for d in DELIMITERS for x in (F.lit(d), (F.length(t) - F.length(F.replace(t, F.lit(d), F.lit("")))).cast("long"))))


def delimiter(text: Column | str) -> Column:
    """The most frequent candidate; a space only if no other reaches half its count."""
    counts = delimiter_counts(text)
    ordered = lambda ds: F.array_sort(F.transform(F.array(*map(F.lit, ds)), lambda d: F.struct((-counts[d]).alias("n"), F.array_position(F.array(*map(F.lit, DELIMITERS)), d).alias("i"), d.alias("d"))))
    best, other = ordered(DELIMITERS)[0], ordered(DELIMITERS[:-1])[0]
    return F.when((best["d"] == " ") & (-other["n"] * 2 >= -best["n"]) & (other["n"] < 0), other["d"]).when(best["n"] == 0, ",").otherwise(best["d"])


def csv_files(spark: SparkSession, path: str) -> tuple[list[str], list[str], bool]:
    """(UTF-8 files, other files, whether a quoted value holds a line break), told from every line of every file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    facts = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("open")).collect()  # a row for each file
    names = [[unquote(r.file) for r in facts if r.utf8 == kind] for kind in (True, False)]
    return *names, any(r.open for r in facts)


def read_csv(spark: SparkSession, path: str, head_lines: int = 100, malformed: str = "_malformed", header: bool | None = None) -> DataFrame:
    """The rows of CSV files as trimmed strings, and ``malformed``: the raw record where it has more or fewer values than there are columns, else null.

    A file with a byte sequence that is no UTF-8, wherever it stands, is read as ISO-8859-1. Quoted values may hold line breaks: if a line of
    any file leaves a quote open, files are read whole, else in splits. The delimiter is what
    the first line has most of outside quotes, else what the first ``head_lines`` lines have; these also tell whether there is a header, unless ``header`` says so. All files have the same columns. Short rows have nulls at their end, long ones lose what has no column but for ``malformed``. Columns without a header are
    named _c0, _c1, .. Files without a line give no rows and no columns of their own.
    """
    utf8, other, open_quotes = csv_files(spark, path)
    if not utf8 and not other:
        return spark.createDataFrame([], f"{malformed} string")
    first = (utf8 or other)[0]
    lines = spark.read.text(first).select(F.col("value").cast("binary")).limit(head_lines).collect()
    head = b"\n".join(bytes(r[0]) for r in lines).decode("utf-8-sig" if utf8 else "latin-1")
    line = re.sub(r'"(?:[^"]|"")*(?:"|$)', "", head.split("\n", 1)[0])
    sep = max(DELIMITERS[:-1], key=line.count)
    if not line.count(sep):
        sep = spark.range(1).select(delimiter(F.lit(head))).first()[0]
    if header is None:
        try:
            header = csv.Sniffer().has_header(head)
        except csv.Error:
            header = True
    reader = {"sep": sep, "header": str(header).lower(), "escape": '"', "multiLine": str(open_quotes).lower(), "mode": "PERMISSIVE"}
    columns = spark.read.options(**reader, encoding="UTF-8" if utf8 else "ISO-8859-1").csv(first).columns
    schema = StructType([StructField(c, StringType()) for c in [*columns, malformed]])
    kinds = [(files, encoding) for files, encoding in ((utf8, "UTF-8"), (other, "ISO-8859-1")) if files]
    parts = [spark.read.schema(schema).options(**reader, encoding=encoding, columnNameOfCorruptRecord=malformed).csv(files) for files, encoding in kinds]
    rows = reduce(DataFrame.union, parts)
    return rows.select(*(F.trim(F.col(f"`{c}`")).alias(c) for c in columns), malformed)


def rendered_rows(df: DataFrame, number: Column, *columns: str) -> DataFrame:
    """Rows as "Row n: column: value | .."; the header counts as row 1."""
    cells = F.concat_ws(" | ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))
    return df.select((number + 1).cast("long").alias("row_number"), F.concat(F.lit("Row "), (number + 1).cast("string"), F.lit(": "), cells).alias("line"))


def column_types(df: DataFrame) -> DataFrame:
    """(column, type) of string columns: empty, integer, float, boolean, date or string, over all rows."""
    tests = {"integer": r"^[+-]?\d+$", "float": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", "boolean": r"(?i)^(true|false|yes|no)$", "date": r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})"}
    aggs = []
    for c in df.columns:
        v = F.trim(F.col(c).cast("string"))
        some = v.isNotNull() & (v != "")
        kind = F.when(F.count_if(some) == 0, "empty")
        for name, p in tests.items():
            kind = kind.when(F.bool_and(F.when(some, v.rlike(p))), name)
        aggs.append(kind.otherwise("string").alias(c))
    one = df.agg(*aggs)
    return one.select(F.explode(F.create_map(*(x for c in df.columns for x in (F.lit(c), F.col(c))))).alias("column", "type"))


# --- HTML


def html_title(html: Column | str) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def html_counts(html: Column | str) -> dict[str, Column]:
    n = lambda p: F.regexp_count(F.col(html) if isinstance(html, str) else html, F.lit(bounded(p))).cast("long")
    return {"links": n(r"(?i)<a\s[^>]*href="), "images": n(r"(?i)<img\b"), "headings": n(r"(?i)<h[1-6]\b"), "paragraphs": n(r"(?i)<p\b"), "lists": n(r"(?i)<(?:ul|ol)\b")}


def html_links(pages: DataFrame, id_col: str, html: str, most: int = 100, clip: int = 200) -> DataFrame:
    """(id, place, url): distinct link targets in order of first use."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href="([^"]*)\""""), 1))
    rows = pages.select(id_col, F.posexplode(F.slice(F.filter(found, lambda u: u != ""), 1, most)).alias("p", "u"))
    return rows.select(id_col, (F.col("p") + 1).cast("long").alias("place"), F.substring("u", 1, clip).alias("url"))


_TAG = r"""(?:"[^"]*"|'[^']*'|[^>"'])*>"""
_ATTRIBUTE = r"""([^\s=/"'<>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
#: Character references that are told apart in attributes and headings.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescaped(c: Column) -> Column:
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), REFERENCES.items(), c)


def tags_of(html: Column, name: str) -> Column:
    """The start tags of an element, as written."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?=[\s/>]){_TAG}"), 0)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's first value in a start tag, null where it has none; names match in any case."""
    names, values = (F.regexp_extract_all(tag, F.lit(f"(?s){_ATTRIBUTE}"), k) for k in (1, 2))
    value = F.get(values, (F.array_position(F.transform(names, F.lower), name) - 1).cast("int"))
    quoted = F.substring(value, 1, 1).isin("'", '"')
    return unescaped(F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value))


def html_metadata(pages: DataFrame, id_col: str, html: str, most: int = 10, most_domains: int = 20) -> DataFrame:
    """A page's title, description, keywords, author, robots, all its meta tags and open-graph tags, JSON-LD, headings, links and images.

    ``meta`` and ``open_graph`` map names (of ``meta`` in lower case) to the content of their last tag; tags without content do not count. ``json_ld``
    has a VARIANT for each script that parses. ``headings`` maps h1 to h6 to their first ``most`` texts. Comments, and scripts and styles but for
    JSON-LD, do not count. A null page has nulls and empty lists and maps.
    """
    bare = F.regexp_replace(F.coalesce(F.col(html).cast("string"), F.lit("")), r"(?s)<!--.*?-->", "")
    body = F.regexp_replace(bare, r"(?is)<(script|style)(?=[\s/>]).*?</\1\s*>", "")

    def plain(c: Column) -> Column:
        return unescaped(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "), r"^\s+|\s+$", ""))

    def last(entries: Column) -> Column:
        """A map of entries whose first of each key counts."""
        keys = F.transform(entries, lambda x: x["k"])
        return F.map_from_entries(F.filter(entries, lambda e, k: F.array_position(keys, e["k"]) == k + 1))

    def named(name: str) -> Column:
        return F.try_element_at(F.transform(F.filter("metas", lambda m: m["name"] == name), lambda m: m["content"]), F.lit(-1))

    meta = F.transform(
        tags_of(F.col("body"), "meta"),
        lambda t: F.struct(F.lower(F.coalesce(attribute(t, "name"), F.lit(""))).alias("name"), F.coalesce(attribute(t, "property"), F.lit("")).alias("property"), F.coalesce(attribute(t, "content"), F.lit("")).alias("content")),
    )
    scripts = F.regexp_extract_all("bare", F.lit(r"""(?is)<script(?=[^>]*?\stype\s*=\s*["']?application/ld\+json["'\s>])[^>]*>(.*?)</script\s*>"""), 1)
    rows = pages.select(F.col(id_col), bare.alias("bare"), body.alias("body")).withColumns(
        {
            "metas": F.filter(meta, lambda m: m["content"] != ""),
            "hrefs": F.transform(tags_of(F.col("body"), "a"), lambda t: attribute(t, "href")),
            "alts": F.transform(tags_of(F.col("body"), "img"), lambda t: attribute(t, "alt")),
        }
    )
    entries = F.transform(F.reverse("metas"), lambda m: F.struct(F.when(m["name"] != "", m["name"]).otherwise(F.lower(m["property"])).alias("k"), m["content"].alias("v")))
    graph = F.transform(F.filter(F.reverse("metas"), lambda m: m["property"].startswith("og:")), lambda m: F.struct(m["property"].alias("k"), m["content"].alias("v")))
    keywords = F.filter(F.transform(F.split(named("keywords"), ","), lambda k: F.trim(k)), lambda k: k != "")
    levels = [F.struct(F.lit(f"h{n}").alias("k"), F.transform(F.slice(F.regexp_extract_all("body", F.lit(rf"(?is)<h{n}(?=[\s/>])[^>]*>(.*?)</h{n}\s*>"), 1), 1, most), plain).alias("v")) for n in range(1, 7)]
    hosts = F.transform("hrefs", lambda u: F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)", 1))
    title = F.regexp_extract("body", r"(?is)<title(?=[\s/>])[^>]*>(.*?)</title\s*>", 1)
    return rows.select(
        F.col(id_col),
        F.nullif(plain(title), F.lit("")).alias("title"),
        *(named(n).alias(n) for n in ("description", "author", "robots")),
        F.coalesce(keywords, F.array().cast("array<string>")).alias("keywords"),
        last(F.filter(entries, lambda e: e["k"] != "")).alias("meta"),
        last(graph).alias("open_graph"),
        F.filter(F.transform(scripts, lambda x: F.try_parse_json(x)), lambda j: j.isNotNull()).alias("json_ld"),
        F.map_from_entries(F.filter(F.array(*levels), lambda e: F.size(e["v"]) > 0)).alias("headings"),
        F.size("hrefs").cast("long").alias("total_links"),
        F.slice(F.array_sort(F.array_distinct(F.filter(hosts, lambda d: d != ""))), 1, most_domains).alias("linked_domains"),
        F.size("alts").cast("long").alias("total_images"),
        F.size(F.filter("alts", lambda x: F.coalesce(x, F.lit("")) != "")).cast("long").alias("images_with_alt"),
    )


# Elements that are dropped, and inline elements.
DROPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "iframe", "button", "input", "svg", "canvas", "object"}
# What marks the main content, the surest first. Of the first kind that a page has, its first element counts.
MAIN = ["main", "article", 'div[role="main"]', ".main-content", "#main-content", ".content", "#content", ".post-content", ".article-content"]
BLOCKS = {"p", "div", "section", "article", "main", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "title"}
VOID = {"br", "img", "meta", "link", "hr", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


def main_marks(tag: str, attrs: dict[str, str | None]) -> int:
    """A bit for each kind of ``MAIN`` that an element is."""
    classes, name = (attrs.get("class") or "").split(), attrs.get("id")
    own = [k for k in MAIN if k == tag or k[0] == "." and k[1:] in classes or k[0] == "#" and k[1:] == name]
    if tag == "div" and attrs.get("role") == "main":
        own.append(MAIN[2])
    return sum(1 << MAIN.index(k) for k in own)


class Walker(HTMLParser):
    """Structured text of a page: headings as # lines, list items, quotes and paragraphs; tables and links beside them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[tuple[int, str]] = []
        self.links: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.now: list[str] = []
        self.mark = ""
        self.skip = 0
        self.inside = self.found = 0
        self.open: list[tuple[str, bool, int]] = []
        self.opened: Counter[str] = Counter()
        self.stack: list[str] = []
        self.number = 0

    def flush(self) -> None:
        line = " ".join("".join(self.now).split())
        if line:
            self.parts.append((self.inside, self.mark + line))
        self.now, self.mark = [], ""

    def handle_starttag(self, tag, attrs):
        dropped = tag in DROPPED
        marks = 0 if self.skip or dropped or tag in VOID else main_marks(tag, dict(attrs)) & ~self.found
        self.found |= marks
        if not self.skip and (dropped or marks or tag in BLOCKS or tag in ("br", "tr")):
            self.flush()
        if tag not in VOID:
            self.open.append((tag, dropped, marks))
            self.opened[tag] += 1
            self.skip += dropped
            self.inside |= marks
        if self.skip or dropped:
            return
        if tag == "a" and (href := dict(attrs).get("href")) and href not in self.links:
            self.links.append(href)
        if tag in ("ul", "ol"):
            self.stack.append(tag)
            self.number = 0
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.mark = "#" * int(tag[1]) + " "
        if tag == "li":
            self.number += 1
            self.mark = f"{self.number}. " if self.stack and self.stack[-1] == "ol" else "- "
        if tag == "blockquote":
            self.mark = "> "
        if tag == "table":
            self.tables.append([])
        if tag == "tr" and self.tables:
            self.tables[-1].append([])
        if tag in ("td", "th") and self.tables and self.tables[-1]:
            self.now = []

    def handle_endtag(self, tag):
        """Closes the innermost open element of the name and all within it; an end without a start closes nothing."""
        if not self.opened[tag]:
            return
        if not self.skip and tag in BLOCKS:
            self.flush()
        name = None
        while name != tag:
            name, dropped, marks = self.open.pop()
            self.opened[name] -= 1
            self.skip -= dropped
            if marks and not self.skip:
                self.flush()
            self.inside &= ~marks
        if self.skip or dropped:
            return
        if tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append(" ".join("".join(self.now).split()))
            self.now = []
        if tag in ("ul", "ol") and self.stack:
            self.stack.pop()

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)


def walk(html: str | None) -> tuple[str, int, int, list[str]]:
    """(text, tables, links, linked domains): the first element of the surest kind of main content that the page has, else everything."""
    w = Walker()
    w.feed(html or "")
    w.close()
    w.flush()
    best = w.found & -w.found
    texts = [t for inside, t in w.parts if not best or inside & best]
    domains = sorted({d for u in w.links if (d := urlparse(u).netloc)})
    return "\n\n".join(texts), len(w.tables), len(w.links), domains[:20]


def html_text(pages: DataFrame, id_col: str, html: str, most: int = 1_000_000) -> DataFrame:
    """(id, text, n_tables, n_links, domains) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A few pages at a time, so that no batch's texts are held beside its pages.
        for b in (b.slice(at, 128) for b in batches for at in range(0, len(b), 128)):
            texts, tables, links, domains = zip(*(walk(h.as_py()) for h in b.column(1)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t[:most] for t in texts], pa.string()), pa.array(tables, pa.int64()), pa.array(links, pa.int64()), pa.array(domains, pa.list_(pa.string()))], [id_col, "text", "n_tables", "n_links", "domains"])

    return pages.select(id_col, html).mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, text string, n_tables long, n_links long, domains array<string>")


def html_tables(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, table_index, row_index, cells)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, h in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
                w = Walker()
                w.feed(h or "")
                rows += [(i, t, n, cells) for t, table in enumerate(w.tables) for n, cells in enumerate(table) if any(cells)]
            yield pd.DataFrame(rows, columns=[id_col, "table_index", "row_index", "cells"])

    return pages.select(id_col, html).mapInPandas(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, table_index long, row_index long, cells array<string>")


# Tags and attributes that sanitised pages may have.
ALLOWED_TAGS = ["p", "br", "b", "i", "u", "strong", "em", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "code", "blockquote", "a", "img", "table", "tr", "td", "th", "thead", "tbody"]
ALLOWED_ATTRIBUTES = {"a": ["href", "title", "target"], "img": ["src", "alt", "title", "width", "height"], "table": ["border", "cellpadding", "cellspacing"], "*": ["class", "id"]}
SCHEMES = ("http", "https", "mailto")


def safe_url(url: str) -> bool:
    """Whether a link has an allowed scheme or none; blanks and control characters in front of or within the scheme do not hide it."""
    scheme, colon, _ = "".join(c for c in url if c > " ").partition(":")
    return not colon or any(c in scheme for c in "/?#") or scheme.lower() in SCHEMES


class Sanitizer(HTMLParser):
    """Allowed tags with allowed attributes; text and character references as they are; scripts and styles go whole."""

    def __init__(self, tags: list[str]):
        super().__init__(convert_charrefs=False)
        self.tags, self.out, self.skip = set(tags), [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif not self.skip and tag in self.tags:
            names = ALLOWED_ATTRIBUTES["*"] + ALLOWED_ATTRIBUTES.get(tag, [])
            kept = [(k, v or "") for k, v in attrs if k in names and (k not in ("href", "src") or safe_url(v or ""))]
            self.out.append(f"<{tag}{''.join(f' {k}="{escape(v)}"' for k, v in kept)}>")

    def handle_startendtag(self, tag, attrs):
        if tag not in ("script", "style"):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in self.tags and tag not in VOID:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data.replace("<", "&lt;"))

    def handle_entityref(self, name):
        if not self.skip:
            self.out.append(f"&{name};")

    def handle_charref(self, name):
        if not self.skip:
            self.out.append(f"&#{name};")


def sanitized(html: str, tags: list[str]) -> str:
    s = Sanitizer(tags)
    s.feed(html)
    s.close()
    return "".join(s.out)


def sanitize_html(html: Column | str, allowed: list[str] | None = None) -> Column:
    """Tags outside an allow-list are dropped, their text stays; attributes outside theirs and links of other schemes go."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if h is None else sanitized(h, allowed or ALLOWED_TAGS) for h in b], dtype="object")

    return run(html)


# --- benchmark and fine-tuning sets


def squad(spark: SparkSession, path: str) -> DataFrame:
    """(query, reference, context) of nested article / paragraph / question JSON; the first answer counts, a question without any has null."""
    raw = spark.read.option("multiLine", "true").json(path)
    paragraphs = raw.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    return paragraphs.select("p.context", F.explode("p.qas").alias("q")).select(F.col("q.question").alias("query"), F.get("q.answers", F.lit(0))["text"].alias("reference"), "context")


def qa_pairs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Questions and answers of JSON lines and CSV files; rows without either are dropped."""
    read = lambda p: spark.read.option("header", "true").csv(p) if p.endswith(".csv") else spark.read.json(p)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(read, paths))
    return rows.where("length(question) > 0 AND length(answer) > 0")


def segments_text(segments: Column | str) -> Column:
    """Transcript lines "[start - end] text" of an array of (start, end, text)."""
    stamp = lambda s: F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), F.floor(s % 60).cast("int"))
    return F.array_join(F.transform(segments, lambda s: F.concat(F.lit("["), stamp(s["start"]), F.lit(" - "), stamp(s["end"]), F.lit("] "), s["text"])), "\n")


# --- sinks


def export(df: DataFrame, path: str, kind: str) -> None:
    """Rows as JSON lines, CSV with doubled quotes, or text."""
    if kind == "json":
        df.write.json(path)
    elif kind == "csv":
        kept = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        df.write.options(header="true", quote='"', escape='"', **kept).csv(path)
    elif kind == "txt":
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown format {kind}")


def sse_frames(event: Column, data: Column, event_id: Column, retry: int = 1000) -> Column:
    """Server-sent event frames."""
    return F.concat(F.lit("event: "), event, F.lit("\nid: "), event_id.cast("string"), F.lit("\nretry: %d\ndata: " % retry), data, F.lit("\n\n"))


def save_store(df: DataFrame, path: str, vec_col: str, cell: str | None = None) -> None:
    """A vector table, by cell if it has one; the dimension is checked when it is read."""
    writer = df.write
    (writer.partitionBy(cell) if cell else writer).parquet(path)


def load_store(spark: SparkSession, path: str, vec_col: str, dim: int) -> DataFrame:
    from quillspark.functions.vector import check_dimension

    return spark.read.parquet(path).withColumn(vec_col, check_dimension(vec_col, dim))

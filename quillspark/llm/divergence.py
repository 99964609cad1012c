"""Source divergence audit: how far the term shares of each source stand from its sibling sources and from its language.

Tasks count the terms of their texts and send one row for each (lang, source, term) they met. Rows are hashed
into shards by (lang, term), sorted, and read in blocks of whole terms by DuckDB, whose SQL sums the counts and keeps
the terms in at least ``min_docs`` texts of the language. A second pass over the same shards, with the groups' totals at hand,
sums the divergences of pairs of sources. Spark merges the partial sums and ranks them.

A pair's sum runs over all kept terms, also those that one or both lack. With f(x, y) a term's value, x and y the shares
of two groups and x0, y0 those of a term that they lack, the sum is V * f(x0, y0), plus f(x, y0) - f(x0, y0)
for each term of the first group and likewise for the second, plus f(x, y) - f(x, y0) - f(x0, y) + f(x0, y0) for each term of both.
So shards only join the sources that hold a term, and the middle part needs only how often each count occurs in a group.

Null texts, languages and sources count as ''. Repeated rows count each. A group without kept terms has the share of lacking
terms everywhere; where a language keeps no term, every pair's value is 0. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize

#: Bytes of terms in lower case (ASCII letters and all that is not ASCII); other bytes become blanks.
TERM_BYTES = bytes(b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 0x20 for b in range(256))
SCALE = 1_000_000_000
PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])
KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("head", pa.int64())])
FOUND = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("n", pa.int64())])

FOLD = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM shard GROUP BY ALL"
KEEP = f"""SELECT lang, source, term, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::BIGINT AS head
FROM ({FOLD}) QUALIFY sum(d) OVER (PARTITION BY lang, term) >= $least"""
SHARES = f"""CREATE OR REPLACE TEMP TABLE share AS SELECT lang, source, term, n,
(1 + {SCALE}::HUGEINT * (n + 2) // (total + 2 * v))::BIGINT AS p, (1 + {SCALE}::HUGEINT * 2 // (total + 2 * v))::BIGINT AS p0,
(1 + {SCALE}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2) // (lang_total + 2 * v))::BIGINT AS q FROM shard"""
SUMS = """SELECT 'pair' AS part, a.lang, a.source, b.source AS item, sum(f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0))::BIGINT AS value, NULL::BIGINT AS n
FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL SELECT 'count', lang, source, NULL, count(*), n FROM share GROUP BY ALL
UNION ALL SELECT 'term', lang, source, term, f(p, q), NULL FROM share WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= """


def partial_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, most: int = 300_000) -> DataFrame:
    """(lang, source, term, n, d) of what each task met: occurrences and texts; a task holds about ``most`` terms at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        read = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (occurrences, texts) in held.items():
                if not occurrences:
                    continue
                terms = pa.array(occurrences.keys(), pa.binary()).cast(pa.string())
                counts = [pa.array(occurrences.values(), pa.int64()), pa.array(map(texts.__getitem__, occurrences), pa.int64())]
                same = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, terms, *counts], schema=PARTIAL)
            held.clear()

        for b in batches:
            for lang, source, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words = text.encode().translate(TERM_BYTES).split()
                distinct = set(words)
                occurrences, texts = held[lang, source]
                occurrences.update(words)
                texts.update(distinct)
                read += len(distinct)
                if read > most:
                    # Terms met again are few among so many only by count, so what is held is counted itself before it goes.
                    read = sum(len(x) for x, _ in held.values())
                    if read > most // 2:
                        yield from flush()
                        read = 0
        yield from flush()

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return docs.select(*plain).mapInArrow(run, "lang string, source string, term string, n long, d long")


def whole_terms(batches: Iterator[pa.RecordBatch], con: duckdb.DuckDBPyConnection, most: int, fold: str | None) -> Iterator[pa.Table]:
    """Tables of about ``most`` rows that hold all rows of each of their (lang, term); rows come sorted by these. One term's rows are folded by ``fold`` when they fill a table."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        waiting.append(b)
        rows += len(b)
        if rows < most:
            continue
        table = pa.Table.from_batches(waiting)
        last = len(table) - 1
        key = (table["lang"][last], table["term"][last])
        low, high = 0, last  # the first row of the last term
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if (table["lang"][mid], table["term"][mid]) == key else (mid + 1, high)
        if low:
            yield table.slice(0, low)
        rest = table.slice(low).combine_chunks()
        if not low and fold:
            con.register("shard", rest)
            rest = con.sql(fold).to_arrow_table()
        waiting, rows = rest.to_batches(), 0 if not low else len(rest)
    if waiting:
        yield pa.Table.from_batches(waiting)


def connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
    con.execute("CREATE MACRO f(p, q) AS (p - q) * (p - q) // (p + q)")
    return con


def shards(rows: DataFrame) -> DataFrame:
    """Rows hashed by (lang, term) and sorted by them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "lang", "term").sortWithinPartitions("lang", "term")


def kept_counts(partial: DataFrame, min_docs: int, block: int) -> DataFrame:
    """(lang, source, term, n, head) of kept terms; head is 1 in one row of each (lang, term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for table in whole_terms(batches, con, block, FOLD):
            con.register("shard", table)
            yield from con.sql(KEEP, params={"least": min_docs}).to_arrow_table().cast(KEPT).to_batches()

    return shards(partial).mapInArrow(run, "lang string, source string, term string, n long, head long")


def partial_sums(kept: DataFrame, top: int, block: int) -> DataFrame:
    """(part, lang, source, item, value, n): partial sums of pairs, how many terms have each count, and candidates for the terms' ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for table in whole_terms(batches, con, block, None):
            con.register("shard", table)
            con.execute(SHARES)
            yield from con.sql(SUMS + str(int(top))).to_arrow_table().cast(FOUND).to_batches()

    return shards(kept).mapInArrow(run, "part string, lang string, source string, item string, value long, n long")


def share(n: str) -> Column:
    """1 + floor(SCALE * n / (total + 2 * v)), null where there is nothing to divide by."""
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(12,0)) * CAST({n} AS DECIMAL(20,0)) div nullif(CAST(total + 2 * v AS DECIMAL(20,0)), 0)")


def value(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10, block: int = 200_000) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language, part ``term`` the ``top`` terms that the source has more of than its language."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"))]
    kept = materialize(kept_counts(partial_counts(docs, text_col, lang_col, source_col), min_docs, block), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("head").alias("v"))
    groups = docs.select(*plain).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = materialize(groups.withColumn("p0", share("2")), "groups")
    found = materialize(partial_sums(kept.join(groups.drop("p0"), ["lang", "source"]), top, block), "partial-sums")
    discard(kept)

    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    lacking = groups.join(others, "lang").where("source <> item").select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * value("p0", "q0")).otherwise(0).alias("value"))
    both = found.where("part = 'pair'").select("lang", "source", "item", "value")
    counts = found.where("part = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").alias("terms")).join(groups, ["lang", "source"]).withColumn("p", share("(n + 2)"))
    one = counts.join(others, "lang").where("source <> item").select("lang", "source", "item", (F.col("terms") * (value("p", "q0") - value("p0", "q0"))).alias("value"))
    parts = both.union(one).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    mirrored = parts.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = lacking.union(parts).union(mirrored).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = found.where("part = 'term'").select("lang", "source", "item", "value", "part")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY ALL),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v))::BIGINT AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
both_parts AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM terms),
ranked AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

"""Smaller operators of the ingestion, query and service layers, as plans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import drop_stopwords
from quillspark.operators import keyword, prompts, vectors


def pack_batches(df: DataFrame, id_col: str, text_col: str, most_tokens: int = 8000, most_texts: int = 100) -> DataFrame:
    """(id, batch, tokens): texts of each partition, longest first, filled greedily into batches; ids keep results with their rows."""
    rows = df.select(id_col, prompts.token_estimate(text_col).alias("tokens"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, used, n = 0, 0, 0
        for pdf in batches:
            out = []
            for t in pdf["tokens"]:
                if n and (used + t > most_tokens or n >= most_texts):
                    number, used, n = number + 1, 0, 0
                used, n = used + t, n + 1
                out.append(number)
            yield pd.DataFrame({id_col: pdf[id_col], "batch": pdf["part"].astype(str) + "-" + pd.Series(out, index=pdf.index, dtype="int64").astype(str), "tokens": pdf["tokens"]})

    return rows.sortWithinPartitions(F.col("tokens").desc(), id_col).mapInPandas(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, batch string, tokens long")


def memory_estimate(store: DataFrame, vec_col: str) -> DataFrame:
    """Megabytes of a vector store and what to do about it."""
    mb = F.col("n_bytes") / 1048576.0
    advice = F.when(mb > 1000, "use an inverted file").when(mb > 100, "consider an inverted file").otherwise("exact search is fine")
    return vectors.store_stats(store, vec_col).select("n_vectors", mb.alias("mb"), advice.alias("recommendation"))


def nearest_terms(queries: DataFrame, terms: DataFrame, k: int = 5, least: float = 0.7, query_id: str = "query_id", query_vec: str = "embedding", term_id: str = "term_id", term_vec: str = "embedding") -> DataFrame:
    """Vocabulary terms closest to a query above a similarity."""
    return vectors.knn(terms, queries, k, id_col=term_id, vec_col=term_vec, query_id=query_id, query_col=query_vec, threshold=least)


def nli_score(label: Column, p: Column) -> Column:
    """Faithfulness of one entailment label with its probability."""
    return F.when(label == "entailment", p).when(label == "neutral", 0.5 + (p - 0.5) / 2).when(label == "contradiction", 1.0 - p)


def nli_scores(rows: DataFrame, by: str, label: str, p: str, least: float = 0.5) -> DataFrame:
    s = nli_score(F.col(label), F.col(p))
    grouped = rows.groupBy(by).agg(F.avg(s).alias("score"), F.greatest(F.lit(0.0), 1.0 - F.stddev_pop(s)).alias("confidence"))
    return grouped.withColumn("faithful", F.col("score") >= least)


def truncate_to_tokens(c: Column, most: int, side: str = "end") -> Column:
    """Text cut to a token limit by the estimate of four characters a token, with a margin of a twentieth."""
    n = F.floor(F.length(c) / 4)
    keep = F.floor(F.length(c) * (most / F.greatest(n, F.lit(1))) * 0.95).cast("int")
    cut = F.substring(c, F.lit(1), keep) if side == "end" else F.substring(c, F.length(c) - keep + 1, keep)
    return F.when(n <= most, c).otherwise(cut)


# States and kinds that an overview always lists.
STATUSES = ["draft", "running", "paused", "completed", "cancelled"]


def overview(rows: DataFrame, status: str, all_statuses: list[str] = STATUSES) -> DataFrame:
    """Counts of every status, those without rows too."""
    every = rows.sparkSession.createDataFrame([(s,) for s in all_statuses], "status string")
    return every.join(rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n")), "status", "left").fillna(0, ["n"])


def experiments_listed(rows: DataFrame, created: str, done: str, size: str, where: Column | None = None, most: int = 50) -> DataFrame:
    """Newest experiments first, with their progress in per cent."""
    kept = rows.where(where) if where is not None else rows
    return kept.orderBy(F.col(created).desc(), F.col(kept.columns[0])).limit(most).withColumn("progress", F.least(F.lit(100.0), F.col(done) / F.greatest(F.col(size), F.lit(1)) * 100))


def prompts_with_tags(rows: DataFrame, tags: list[str], kind: str | None = None, active_only: bool = True) -> DataFrame:
    cond = F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    cond = cond & (F.col("kind") == kind) if kind else cond
    return rows.where(cond & F.col("active") if active_only else cond)


def config_issues(rows: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """``rows`` with issues: the settings outside their ranges or missing."""
    issue = [F.when(F.col(c).isNull() | (F.col(c) < lo) | (F.col(c) > hi), F.lit(f"{c} must be within {lo:g} and {hi:g}")) for c, (lo, hi) in rules.items()]
    return rows.withColumn("issues", F.array_compact(F.array(*issue)))


def containing(docs: DataFrame, chunks: DataFrame, doc_id: str, text: str, chunk_id: str, chunk: str, block: int = 500) -> DataFrame:
    """(chunk, doc): the first document that contains each chunk; chunks that none contains, and null ones, have no row.

    A document that contains a chunk has all its inner tokens, so chunks meet documents on their rarest inner
    token and only those pairs are compared. Distinct chunks without an inner token meet all documents, in blocks of ``block``;
    an empty chunk is in every text.
    """
    index = keyword.build_index(docs, doc_id, text)
    rows = chunks.select(chunk_id, F.col(chunk).alias("_chunk")).where("_chunk IS NOT NULL")
    inner = drop_stopwords(F.slice("ts", 2, F.greatest(F.size("ts") - 2, F.lit(0))))
    parted = rows.withColumn("ts", F.filter(F.split(F.regexp_replace(F.lower("_chunk"), "[^a-z0-9]+", " "), " "), lambda t: t != "")).withColumn("inner", inner)
    tokens = parted.select(chunk_id, "_chunk", F.explode("inner").alias("term"))
    w = Window.partitionBy(chunk_id, "_chunk").orderBy("df", "term")
    rare = tokens.join(index.terms.select("term", "df"), "term").withColumn("_r", F.row_number().over(w)).where("_r = 1").select(chunk_id, "_chunk", "term")
    texts = docs.select(doc_id, F.col(text).alias("_text"))
    met = index.postings.join(rare, "term").select(chunk_id, "_chunk", doc_id).join(texts, doc_id)
    found = [met.where(F.contains("_text", F.col("_chunk"))).select(chunk_id, doc_id)]
    short = parted.where("size(inner) = 0").select("_chunk").distinct()
    blocks = -(-short.count() // block)
    for k in range(blocks):
        some = F.broadcast(short.where(F.pmod(F.xxhash64("_chunk"), F.lit(blocks)) == k))
        first = texts.join(some, F.contains("_text", F.col("_chunk"))).groupBy("_chunk").agg(F.min(doc_id).alias(doc_id))
        found.append(parted.where("size(inner) = 0").join(first, "_chunk").select(chunk_id, doc_id))
    return reduce(DataFrame.union, found).groupBy(chunk_id).agg(F.min(doc_id).alias(doc_id))


def paced_starts(rows: DataFrame, by: str, arrival: str, id_col: str, rate: float) -> DataFrame:
    """``rows`` with start, in seconds: requests of a key start at least 1 / rate apart, in order of arrival."""
    w = Window.partitionBy(by).orderBy(arrival, id_col)
    t = F.unix_micros(F.col(arrival).cast("timestamp")) / 1e6
    placed = rows.withColumn("_n", F.row_number().over(w) - 1)
    lead = F.max(t - F.col("_n") / rate).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("start", lead + F.col("_n") / rate).drop("_n")


def answered(queries: DataFrame, ranked: DataFrame, query_id: str, text: str, answer, k: int = 3) -> DataFrame:
    """(query, answer): retrieval results of each query handed to an injected generator; equal queries are answered once.

    ``answer`` maps (question, context) columns to a column; an extractive stub serves tests.
    """
    first = queries.groupBy(text).agg(F.min(query_id).alias("_first"))
    context = ranked.where(F.col("rank") <= k).groupBy(query_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("_context"))
    once = first.join(context, first["_first"] == context[query_id], "left").select(text, answer(F.col(text), F.coalesce("_context", F.lit(""))).alias("answer"))
    return queries.join(once, text).select(query_id, "answer")


def extractive(question: Column, context: Column) -> Column:
    """First sentence of the context."""
    from quillspark.functions.text import sentences

    return F.coalesce(F.get(sentences(context), F.lit(0)), F.lit("No context."))


def union_by_weight(parts: list[tuple[DataFrame, float]], key: str, score: str) -> DataFrame:
    return reduce(DataFrame.union, [d.select(key, (F.col(score) * w).alias(score)) for d, w in parts]).groupBy(key).agg(F.sum(score).alias(score))

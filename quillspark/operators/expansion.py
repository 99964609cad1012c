"""Query expansion: synonyms, context terms, decomposition, FAQ terms, nearest terms, and their combination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import query_tokens, strip, words

TERM = ("term", "weight", "source")


def _top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def synonyms(queries: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, per_term: int = 2) -> DataFrame:
    """(id, expanded, confidence): each token followed by up to ``per_term`` synonyms not yet present.

    ``dictionary`` has (term, synonym, place). A synonym that is a token of the query or came with an earlier token is left out.
    """
    tokens = queries.select(id_col, F.posexplode(query_tokens(text_col)).alias("pos", "token"))
    known = tokens.select(id_col, F.col("token").alias("synonym")).distinct()
    found = tokens.join(dictionary, tokens.token == dictionary.term).select(id_col, "pos", "synonym", "place").join(known, [id_col, "synonym"], "left_anti")
    first = _top(found, [id_col, "synonym"], [F.col("pos"), F.col("place")], 1, "_n")
    added = _top(first, [id_col, "pos"], [F.col("place"), F.col("synonym")], per_term)
    both = tokens.select(id_col, "pos", F.lit(0).cast("long").alias("place"), F.col("token").alias("term")).union(added.select(id_col, "pos", "place", F.col("synonym").alias("term")))
    grouped = both.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "place", "term"))), lambda x: x["term"]), " ").alias("expanded"), F.sum((F.col("place") > 0).cast("long")).alias("n_added"), F.sum((F.col("place") == 0).cast("long")).alias("n_tokens"))
    return grouped.select(id_col, "expanded", F.least(F.lit(1.0), 2.0 * F.col("n_added") / (F.col("n_tokens") + 1)).alias("confidence"))


def context_terms(pairs: DataFrame, id_col: str, query: str, context: str, k: int = 10) -> DataFrame:
    """(id, term, n, place): the most frequent terms of a query's context that the query lacks and that have over two characters."""
    rows = pairs.select(id_col, F.array_distinct(query_tokens(query, True)).alias("own"), F.explode(query_tokens(context, True)).alias("term"))
    counted = rows.where((F.length("term") > 2) & ~F.array_contains("own", F.col("term"))).groupBy(id_col, "term").agg(F.count("*").alias("n"))
    return _top(counted, [id_col], [F.col("n").desc(), F.col("term")], k)


def subqueries(text: Column | str, most: int = 3) -> Column:
    """Parts between conjunctions, taken apart one conjunction after another; parts of one word go."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def apart(mark: str):
        return lambda p: F.when(F.contains(p, F.lit(mark)), F.transform(F.split(p, mark), strip)).otherwise(F.array(p))

    parts = F.array(c)
    for mark in (" and ", " or ", " but ", ", "):
        parts = F.flatten(F.transform(parts, apart(mark)))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: F.size(words(p)) > 1)), 1, most)


def decomposed(queries: DataFrame, id_col: str, text_col: str, most: int = 3) -> DataFrame:
    """(id, place, term, weight): subqueries with weights 1.0, 0.9, 0.8."""
    rows = queries.select(id_col, F.posexplode(subqueries(text_col, most)).alias("p", "term"))
    return rows.select(id_col, (F.col("p") + 1).cast("long").alias("place"), "term", (1.0 - 0.1 * F.col("p")).alias("weight"))


def faq_matches(queries: DataFrame, faq: DataFrame, id_col: str, text_col: str, faq_id: str, faq_text: str, least: float = 0.2, k: int = 3) -> DataFrame:
    """(id, faq, overlap, place): the k entries that share the most tokens with a query, by share of the larger set.

    Shared tokens come from an equi-join on tokens, so only pairs that share one are ever formed.
    """
    q = queries.select(id_col, F.array_distinct(query_tokens(text_col, True)).alias("qs"))
    f = faq.select(F.col(faq_id).alias("faq"), F.array_distinct(query_tokens(faq_text, True)).alias("fs"))
    hits = q.select(id_col, F.size("qs").alias("nq"), F.explode("qs").alias("t")).join(f.select("faq", F.size("fs").alias("nf"), F.explode("fs").alias("t")), "t")
    shared = hits.groupBy(id_col, "faq").agg((F.count("*") / F.greatest(F.max("nq"), F.max("nf"))).alias("overlap"))
    return _top(shared.where(F.col("overlap") > least), [id_col], [F.round("overlap", 6).desc(), F.col("faq")], k)


def combined(expansions: list[DataFrame], id_col: str, k: int = 10) -> DataFrame:
    """(id, term, weight, place): all terms, the greatest weight of each, the k heaviest."""
    terms = reduce(DataFrame.union, [e.select(id_col, F.lower("term").alias("term"), F.col("weight").cast("double").alias("weight")) for e in expansions])
    return _top(terms.groupBy(id_col, "term").agg(F.max("weight").alias("weight")), [id_col], [F.round("weight", 6).desc(), F.col("term")], k)

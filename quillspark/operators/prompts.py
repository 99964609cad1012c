"""Token estimates, costs, prompt assembly and the deterministic encoder that stands in for a model."""

from __future__ import annotations

import string

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def token_estimate(c: Column | str, per: float = 4.0) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.floor(F.length(F.coalesce(col, F.lit(""))) / F.lit(per)).cast("long")


def clip_tokens(c: Column, most: int) -> Column:
    return F.substring(c, 1, 4 * most)


def truncate_prompt(c: Column, most: int, marker: str = "\n[Truncated...]") -> Column:
    return F.when(F.length(c) > 4 * most, F.concat(F.substring(c, 1, 4 * most), F.lit(marker))).otherwise(c)


def embedding_key(c: Column, model: str, dim: int | None = None) -> Column:
    return F.md5(F.concat_ws(":", c, F.lit(model), *([F.lit(str(dim))] if dim else [])))


def hashing_encoder(dim: int) -> Callable[[list[str]], np.ndarray]:
    """Signed feature hashing of words, unit length: the same text always has the same vector."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for n, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[n, h % dim] += 1.0 if h >> 63 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1.0, norms)

    return encode


def embed(df: DataFrame, id_col: str, text_col: str, dim: int = 64, encoder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(id, embedding) in Arrow batches; equal texts are encoded once a batch, and results stay with their rows."""
    encode = encoder or hashing_encoder(dim)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            codes, unique = pd.factorize(s.fillna(""))
            vectors = encode(list(unique)).astype("float32")
            yield pd.Series(list(vectors[codes]))

    return df.select(id_col, run(text_col).alias("embedding"))


# Prices of 1,000 prompt and completion tokens, in the order partial names are tried.
PRICES = [
    ("gpt-4", 0.03, 0.06), ("gpt-4-32k", 0.06, 0.12), ("gpt-4-turbo-preview", 0.01, 0.03), ("gpt-4o", 0.005, 0.015), ("gpt-4o-mini", 0.00015, 0.0006), ("gpt-4o-2024-08-06", 0.0025, 0.01), ("gpt-4o-mini-2024-07-18", 0.00015, 0.0006),
    ("gpt-3.5-turbo", 0.0005, 0.0015), ("gpt-3.5-turbo-16k", 0.001, 0.002), ("gpt-3.5-turbo-0125", 0.0005, 0.0015), ("gpt-3.5-turbo-1106", 0.001, 0.002),
    ("text-embedding-3-small", 0.00002, 0.0), ("text-embedding-3-large", 0.00013, 0.0), ("text-embedding-ada-002", 0.00010, 0.0),
    ("claude-3-opus-20240229", 0.015, 0.075), ("claude-3-sonnet-20240229", 0.003, 0.015), ("claude-3-haiku-20240307", 0.00025, 0.00125), ("claude-3-5-sonnet-20241022", 0.003, 0.015),
    ("gemini-1.5-pro", 0.0025, 0.0075), ("gemini-1.5-flash", 0.00035, 0.00105), ("gemini-1.0-pro", 0.0005, 0.0015),
    ("command-r", 0.0005, 0.0015), ("command-r-plus", 0.003, 0.015), ("command", 0.0005, 0.0015),
    ("llama-3.1-70b-versatile", 0.00059, 0.00079), ("llama-3.1-8b-instant", 0.00005, 0.00008), ("mixtral-8x7b-32768", 0.00024, 0.00024),
]
DEFAULT_PRICE = (0.01, 0.02)


def with_cost(df: DataFrame, model: str, prompt_tokens: str, completion_tokens: str) -> DataFrame:
    """``df`` with cost: the price of the exact name, else of the first name that is part of it or that it is part of, else the default."""
    low = F.lower(F.col(model))
    price = F.when(F.lit(False), F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("c")))
    pair = lambda p, c: F.struct(F.lit(float(p)).alias("p"), F.lit(float(c)).alias("c"))
    for name, p, c in PRICES:
        price = price.when(F.col(model) == name, pair(p, c))
    for name, p, c in PRICES:
        price = price.when(F.contains(low, F.lit(name)) | F.contains(F.lit(name), low), pair(p, c))
    price = price.otherwise(pair(*DEFAULT_PRICE))
    return df.withColumn("cost", price["p"] * F.col(prompt_tokens) / 1000.0 + price["c"] * F.col(completion_tokens) / 1000.0)


def contexts(ranked: DataFrame, query: str, text: str, source: str, rank: str = "rank", most: int = 4000) -> DataFrame:
    """(query, context): source blocks in order while they fit; the first that does not is cut if over 100 characters are left."""
    block = F.concat(F.lit("[Source: "), F.col(source).cast("string"), F.lit("]\n"), F.col(text), F.lit("\n"))
    before = F.coalesce(F.sum(F.length("block")).over(Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranked.select(query, rank, block.alias("block")).withColumn("before", before)
    left = F.lit(most) - F.col("before")
    part = F.when(F.length("block") <= left, F.col("block")).when(left > 100, F.concat(F.substring("block", F.lit(1), left.cast("int")), F.lit("...")))
    kept = rows.withColumn("part", part).where("part IS NOT NULL AND before < %d" % most)
    return kept.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, "part"))), lambda x: x["part"]), "\n").alias("context"))


def histories(turns: DataFrame, conv: str, turn: str, role: str, text: str, most: int = 10, clip: int = 500) -> DataFrame:
    """(conv, history): the last messages, clipped; other roles than user and assistant drop out after the cut."""
    last = turns.withColumn("_n", F.row_number().over(Window.partitionBy(conv).orderBy(F.col(turn).desc()))).where(F.col("_n") <= most)
    said = F.when(F.length(text) > clip, F.concat(F.substring(text, 1, clip), F.lit("..."))).otherwise(F.col(text))
    line = F.when(F.col(role) == "user", F.concat(F.lit("User: "), said)).when(F.col(role) == "assistant", F.concat(F.lit("Assistant: "), said))
    rows = last.select(conv, turn, line.alias("line")).where("line IS NOT NULL")
    return rows.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, "line"))), lambda x: x["line"]), "\n").alias("history"))


def scored_blocks(ranked: DataFrame, query: str, text: str, score: str, rank: str = "rank") -> DataFrame:
    """(query, blocks): numbered documents with their relevance, between rules."""
    block = F.concat(F.lit("Document "), F.col(rank).cast("string"), F.lit(" (Relevance: "), F.format_string("%.3f", F.col(score)), F.lit(")\n"), F.col(text))
    rows = ranked.select(query, rank, block.alias("block"))
    return rows.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, "block"))), lambda x: x["block"]), "\n\n---\n\n").alias("blocks"))


def fill(template: str, **values: Column) -> Column:
    """A template with {name} places; values are put in as they are, braces and all. A missing value raises, a null one is empty."""
    parts = list(string.Formatter().parse(template))
    if missing := {n for _, n, _, _ in parts if n} - values.keys():
        raise KeyError(f"missing template variables: {sorted(missing)}")
    return F.concat(F.lit(""), *(x for text, n, _, _ in parts for x in (F.lit(text), *([F.coalesce(values[n].cast("string"), F.lit(""))] if n else []))))


QA_TEMPLATE = "Answer the question from the context.\n\nContext:\n{context}\n\nQuestion: {question}\n\nAnswer:"


def variant_weights(events: DataFrame, test: str, variant: str, success: Column, score: Column) -> DataFrame:
    """Softmax weights of a test's prompts by 2 * (0.7 * success rate + 0.3 * mean score); equal weights below 11 uses."""
    rows = events.groupBy(test, variant).agg(F.count("*").alias("uses"), F.avg(success.cast("double")).alias("rate"), F.avg(score).alias("mean_score"))
    w = Window.partitionBy(test)
    e = rows.withColumn("_e", F.exp(2 * (0.7 * F.col("rate") + 0.3 * F.col("mean_score"))))
    weight = F.when(F.sum("uses").over(w) > 10, F.col("_e") / F.sum("_e").over(w)).otherwise(1.0 / F.count("*").over(w))
    return e.withColumn("weight", weight).drop("_e")

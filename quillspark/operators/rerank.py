"""Rerankers over candidate lists (query, item, score, rank, text). Candidate lists are short: a retriever has cut them to k."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import words
from quillspark.operators.ranking import top_k


def reciprocal_rank(rankings: list[DataFrame], query: str, item: str, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over the rankings that hold an item; ranks start at 1."""
    parts = [r.select(query, item, (1.0 / (k + F.col("rank"))).alias("s")) for r in rankings]
    return reduce(DataFrame.union, parts).groupBy(query, item).agg(F.sum("s").alias("score"))


def ensemble(rankings: list[DataFrame], weights: list[float], query: str, item: str, method: str = "weighted") -> DataFrame:
    """Weighted sum, greatest score or reciprocal ranks of several rankings."""
    if method == "rrf":
        return reciprocal_rank(rankings, query, item)
    share = weights if method == "weighted" else [1.0] * len(weights)
    parts = [r.select(query, item, (F.col("score") * w).alias("s")) for r, w in zip(rankings, share, strict=True)]
    return reduce(DataFrame.union, parts).groupBy(query, item).agg((F.sum if method == "weighted" else F.max)("s").alias("score"))


def spliced(ranked: DataFrame, reranked: DataFrame, query: str, item: str) -> DataFrame:
    """``ranked`` (query, item, score, rank) in the order of a reranker: items that it scored come first, by its score, the others follow in their old order.

    Ids are kept throughout, so equal texts are not mixed up. Scores are the reranker's where it has one.
    """
    new = reranked.select(query, item, F.col("score").alias("_new"))
    w = Window.partitionBy(query).orderBy(F.col("_new").isNull(), F.round("_new", 6).desc(), "rank", item)
    joined = ranked.join(new, [query, item], "left").withColumn("_rank", F.row_number().over(w).cast("long"))
    return joined.select(query, item, F.coalesce("_new", "score").alias("score"), F.col("_rank").alias("rank"))


# Feature weights and the words that count as important.
FEATURE_WEIGHTS = {"relevance_score": 0.4, "text_length": 0.1, "query_overlap": 0.2, "position_bonus": 0.1, "keyword_coverage": 0.2}
IMPORTANT_WORDS = ["important", "key", "critical", "main", "significant"]


def by_features(candidates: DataFrame, query_text: str = "query", text: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """``candidates`` with rerank_score, a weighted sum of five features; weights are brought to a sum of 1."""
    w = weights or FEATURE_WEIGHTS
    total = sum(w.values())
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    q, t = F.array_distinct(words(F.lower(query_text))), F.array_distinct(words(low))
    important = reduce(lambda a, b: a + b, [F.contains(low, F.lit(x)).cast("int") for x in IMPORTANT_WORDS])
    features = {
        "relevance_score": F.col("score"),
        "text_length": F.least(F.lit(1.0), F.length(text) / 1000.0),
        "query_overlap": F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)),
        "position_bonus": 1.0 / (1.0 + 0.1 * (F.col("rank") - 1)),
        "keyword_coverage": F.when(F.size(q) == 0, 0.0).otherwise(F.least(F.lit(1.0), important / 3.0)),
    }
    return candidates.withColumn("rerank_score", reduce(lambda a, b: a + b, [features[n] * (v / total) for n, v in w.items()]))


def jaccard_pairs(candidates: DataFrame, query: str, item: str, text: str = "text") -> DataFrame:
    """Word Jaccard similarity of every two candidates of a query; a candidate list has at most k items."""
    c = candidates.select(query, item, F.array_distinct(words(F.lower(text))).alias("w"))
    a, b = c.select(query, F.col(item).alias("doc_a"), F.col("w").alias("wa")), c.select(query, F.col(item).alias("doc_b"), F.col("w").alias("wb"))
    union = F.size(F.array_union("wa", "wb"))
    pairs = a.join(b, query).where("doc_a < doc_b")
    return pairs.select(query, "doc_a", "doc_b", F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect("wa", "wb")) / union).alias("similarity"))


def mmr(candidates: DataFrame, query: str, item: str, text: str = "text", k: int = 5, trade: float = 0.5) -> DataFrame:
    """(query, item, score, rank): greedy maximal marginal relevance; score is min-max relevance, equal gains keep the earlier candidate."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        sets = [set((t or "").lower().split()) for t in pdf["text"]]
        lo, hi = pdf["score"].min(), pdf["score"].max()
        rel = [1.0 if hi == lo else (s - lo) / (hi - lo) for s in pdf["score"]]
        sim = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
        left, chosen = list(range(len(pdf))), []
        while left and len(chosen) < k:
            gain = {n: trade * rel[n] - (1 - trade) * max((sim(sets[n], sets[m]) for m in chosen), default=0.0) for n in left}
            best = max(left, key=lambda n: (gain[n], -n))
            chosen.append(best)
            left.remove(best)
        return pd.DataFrame({query: pdf[query].iloc[chosen].to_numpy(), item: pdf[item].iloc[chosen].to_numpy(), "score": [rel[n] for n in chosen], "rank": range(1, len(chosen) + 1)})

    rows = candidates.select(query, item, F.col(text).alias("text"), "score", "rank")
    return rows.groupBy(query).applyInPandas(choose, f"`{query}` long, `{item}` long, score double, rank long")


def cross_encoder(candidates: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], query: str, item: str, k: int | None = None, query_text: str = "query", text: str = "text") -> DataFrame:
    """Scores pairs with an injected model in Arrow batches, squashes them to 0..1 and ranks; a failing batch scores 0 before squashing."""

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in pairs:
            try:
                yield pd.Series(scorer(q, t)).astype("float64")
            except Exception:
                yield pd.Series([0.0] * len(q))

    scored = candidates.drop("rank").withColumn("score", 1.0 / (1.0 + F.exp(-score(query_text, text))))
    return top_k(scored, query, item, k)


def pipeline(candidates: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], k: int | None = None) -> DataFrame:
    """Rerankers in turn, each on what the one before returned."""
    out = reduce(lambda df, step: step(df), steps, candidates)
    return out if k is None else out.where(F.col("rank") <= k)

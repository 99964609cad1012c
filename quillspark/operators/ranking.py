"""Ranks, score normalisation and fusion of rankings, all as windows and joins over (query, item, score)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, query: str, item: str, k: int | None, score: str = "score", rank: str = "rank") -> DataFrame:
    """The k best rows of each query by (score rounded to 6 digits, item); Spark cuts each partition to k before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.round(F.col(score), 6).desc(), F.col(item))
    ranked = df.withColumn(rank, F.row_number().over(w).cast("long"))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def min_max(score: Column, query: str) -> Column:
    w = Window.partitionBy(query)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi == lo, 1.0).otherwise((score - lo) / (hi - lo))


def z_score(score: Column, query: str) -> Column:
    """Min-max of the z-scores, which is min-max of the scores unless they do not vary."""
    w = Window.partitionBy(query)
    sd, mean = F.stddev_pop(score).over(w), F.avg(score).over(w)
    z = (score - mean) / sd
    lo, hi = (F.min(score).over(w) - mean) / sd, (F.max(score).over(w) - mean) / sd
    return F.when((F.count(score).over(w) < 2) | (sd == 0), 0.5).otherwise((z - lo) / (hi - lo))


def sigmoid(score: Column, k: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-k * score))


def rank_norm(score: Column, query: str, item: str) -> Column:
    w = Window.partitionBy(query)
    return F.lit(1.0) - (F.row_number().over(w.orderBy(F.round(score, 6).desc(), F.col(item))) - 1) / F.count(score).over(w)


def normalize_scores(df: DataFrame, scores: list[str], query: str, item: str, method: str = "min_max", temperature: float = 1.0) -> DataFrame:
    """``df`` with its score columns normalised in each query; unknown methods give min-max."""
    w = Window.partitionBy(query)
    if method == "softmax":
        shifted = df.withColumns({s: F.exp((F.col(s) - F.max(s).over(w)) / temperature) for s in scores})
        return shifted.withColumns({s: F.col(s) / F.sum(s).over(w) for s in scores})
    by: dict[str, Callable[[str], Column]] = {"z_score": lambda s: z_score(F.col(s), query), "sigmoid": lambda s: sigmoid(F.col(s)), "rank": lambda s: rank_norm(F.col(s), query, item)}
    return df.withColumns({s: by.get(method, lambda s: min_max(F.col(s), query))(s) for s in scores})


def combine(rankings: list[DataFrame], query: str, item: str, score: str = "score") -> DataFrame:
    """One row for each (query, item) of any ranking with columns s0, s1, ..; missing scores are 0. A union and one aggregate stand in for full outer joins."""
    parts = [r.select(query, item, *(F.col(score).alias(f"s{n}") if n == k else F.lit(None).cast("double").alias(f"s{n}") for n in range(len(rankings)))) for k, r in enumerate(rankings)]
    return reduce(DataFrame.unionByName, parts).groupBy(query, item).agg(*(F.coalesce(F.max(f"s{n}"), F.lit(0.0)).alias(f"s{n}") for n in range(len(rankings))))


def fused(strategy: str, scores: list[str], weights: list[float], query: str, item: str, k: int = 60) -> Column:
    """The fused score of padded score columns; weights are brought to a sum of 1."""
    total = sum(weights)
    share = [w / total for w in weights]
    cols = [F.col(s) for s in scores]
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    weighted = add([c * w for c, w in zip(cols, share, strict=True)])
    if strategy == "rrf":
        rank = lambda c: F.row_number().over(Window.partitionBy(query).orderBy(F.round(c, 6).desc(), F.col(item)))
        return add([F.lit(w) / (k + rank(c)) for c, w in zip(cols, share, strict=True)])
    if strategy == "max":
        return F.greatest(F.lit(0.0), *cols)
    if strategy == "min":
        return F.least(F.lit(1.0), *cols)
    if strategy == "concave":
        return F.sqrt(weighted)
    if strategy in ("weighted", "average", "linear"):
        return weighted
    raise ValueError(f"unknown fusion strategy {strategy}")


def fuse(rankings: list[DataFrame], query: str, item: str, strategy: str = "rrf", weights: list[float] | None = None, normalize: str | None = "min_max", double_weight: bool = True) -> DataFrame:
    """(query, item, score): rankings combined, normalised, weighted (before and within fusion with ``double_weight``) and fused."""
    weights = weights or [1.0] * len(rankings)
    share = [w / sum(weights) for w in weights]
    names = [f"s{n}" for n in range(len(rankings))]
    df = combine(rankings, query, item)
    if normalize:
        df = normalize_scores(df, names, query, item, normalize)
    if double_weight:
        df = df.select(query, item, *((F.col(n) * w).alias(n) for n, w in zip(names, share, strict=True)))
    return df.select(query, item, fused(strategy, names, weights, query, item).alias("score"))

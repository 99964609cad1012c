"""Retrievers behind one interface: each answers a table of queries with (query, item, score, rank); a factory makes them by kind."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import keyword, proximity, ranking, rerank, vectors

Scorer = Callable[[DataFrame, DataFrame], DataFrame]


class Retriever(Protocol):
    query_id: str
    item_id: str

    def retrieve(self, queries: DataFrame, k: int | None = None, threshold: float | None = None, where: DataFrame | None = None) -> DataFrame:
        """The k best items of each query. ``threshold`` drops lower scores and ``where`` (a table of item ids) other items, both after the cut to k."""


def _kept(found: DataFrame, item: str, threshold: float | None, where: DataFrame | None) -> DataFrame:
    found = found if threshold is None else found.where(F.col("score") >= threshold)
    return found if where is None else found.join(where.select(item).distinct(), item, "left_semi").select(found.columns)


class VectorRetriever:
    """Exact search of a table of vectors, or approximate search of a stored ``CellIndex``."""

    def __init__(self, store: DataFrame | proximity.CellIndex, k: int = 5, metric: str = "cosine", query_id: str = "query_id", item_id: str = "id", store_id: str = "vec_id", vec_col: str = "embedding", query_vec: str = "embedding", probe: int = 10):
        self.store, self.k, self.metric, self.probe = store, k, metric, probe
        self.query_id, self.item_id, self.store_id, self.vec_col, self.query_vec = query_id, item_id, store_id, vec_col, query_vec

    def retrieve(self, queries, k=None, threshold=None, where=None):
        k = k or self.k
        if isinstance(self.store, proximity.CellIndex):
            found = self.store.search(queries, k, self.probe, query_id=self.query_id, query_col=self.query_vec)
        else:
            found = vectors.knn(self.store, queries, k, self.metric, self.store_id, self.vec_col, self.query_id, self.query_vec)
        named = found.select(F.col("query_id").alias(self.query_id), F.col("id").alias(self.item_id), "score", "rank")
        return _kept(named, self.item_id, threshold, where)


class KeywordRetriever:
    """BM25, or cosine of TF-IDF, on a stored keyword index."""

    def __init__(self, index: keyword.Index, k: int = 5, method: str = "bm25", query_id: str = "item_id", text_col: str = "text"):
        if method not in ("bm25", "tfidf"):
            raise ValueError(f"unknown keyword method {method}")
        self.index, self.k, self.method, self.query_id, self.item_id, self.text_col = index, k, method, query_id, index.id_col, text_col

    def retrieve(self, queries, k=None, threshold=None, where=None):
        best = (keyword.bm25_search if self.method == "bm25" else keyword.tfidf_search)(self.index, queries, k or self.k, self.query_id, self.text_col)
        return _kept(best, self.item_id, threshold, where)


def shares(weights: list[float], tolerance: float = 0.01) -> list[float]:
    """Weights brought to a sum of 1 where they are off by more than ``tolerance``."""
    total = sum(weights)
    if total <= 0 or min(weights) < 0:
        raise ValueError("weights must not be negative and need a positive sum")
    return [w / total for w in weights] if abs(total - 1.0) > tolerance else list(weights)


class HybridRetriever:
    """Rankings of several retrievers, ``reach`` times k long, normalised and fused; a reranker may put the first ones in another order."""

    def __init__(self, parts: list[Retriever], weights: list[float] | None = None, k: int = 5, strategy: str = "weighted", normalize: str | None = "min_max", reach: int = 4, reranker: Scorer | None = None):
        self.parts, self.weights = parts, shares(weights or [0.7, 0.3] if len(parts) == 2 or weights else [1.0] * len(parts))
        if len(self.weights) != len(parts):
            raise ValueError("a weight for each retriever is needed")
        self.k, self.strategy, self.normalize, self.reach, self.reranker = k, strategy, normalize, reach, reranker
        self.query_id, self.item_id = parts[0].query_id, parts[0].item_id

    def retrieve(self, queries, k=None, threshold=None, where=None, weights: list[float] | None = None):
        k = k or self.k
        found = [p.retrieve(queries, k * self.reach).select(F.col(p.query_id).alias(self.query_id), F.col(p.item_id).alias(self.item_id), "score") for p in self.parts]
        fused = ranking.fuse(found, self.query_id, self.item_id, self.strategy, shares(weights) if weights else self.weights, self.normalize)
        best = ranking.top_k(fused, self.query_id, self.item_id, k)
        if self.reranker is not None:
            best = rerank.spliced(best, self.reranker(queries, best), self.query_id, self.item_id)
        return _kept(best, self.item_id, threshold, where)


class ContextualRetriever:
    """A retriever whose queries carry the conversation before them; ``history`` has the query id and the text that goes in front."""

    def __init__(self, base: Retriever, history: DataFrame, text_col: str = "text", history_col: str = "history"):
        self.base, self.history, self.text_col, self.history_col = base, history, text_col, history_col
        self.query_id, self.item_id = base.query_id, base.item_id

    def retrieve(self, queries, k=None, threshold=None, where=None):
        joined = queries.join(self.history.select(self.query_id, F.col(self.history_col).alias("_history")), self.query_id, "left")
        full = F.when(F.coalesce("_history", F.lit("")) == "", F.col(self.text_col)).otherwise(F.concat("_history", F.lit("\nCurrent: "), F.coalesce(self.text_col, F.lit(""))))
        return self.base.retrieve(joined.withColumn(self.text_col, full).drop("_history"), k, threshold, where)


class MultiStageRetriever:
    """Candidates of a first retriever, put in order by a second scorer (queries, candidates) -> (query, item, score); candidates that it does not score go."""

    def __init__(self, first: Retriever, second: Scorer, k: int = 5, candidates: int = 20):
        self.first, self.second, self.k, self.candidates = first, second, k, candidates
        self.query_id, self.item_id = first.query_id, first.item_id

    def retrieve(self, queries, k=None, threshold=None, where=None):
        found = self.first.retrieve(queries, self.candidates)
        scored = self.second(queries, found).select(self.query_id, self.item_id, "score")
        kept = found.select(self.query_id, self.item_id).join(scored, [self.query_id, self.item_id])
        return _kept(ranking.top_k(kept, self.query_id, self.item_id, k or self.k), self.item_id, threshold, where)


class EnsembleRetriever:
    """Weighted sums, greatest scores or reciprocal ranks of several retrievers' rankings, each ``reach`` times k long."""

    def __init__(self, parts: list[Retriever], weights: list[float] | None = None, k: int = 5, method: str = "weighted", reach: int = 2):
        self.parts, self.weights, self.k, self.method, self.reach = parts, shares(weights or [1.0] * len(parts)), k, method, reach
        self.query_id, self.item_id = parts[0].query_id, parts[0].item_id

    def retrieve(self, queries, k=None, threshold=None, where=None):
        k = k or self.k
        found = [p.retrieve(queries, k * self.reach).select(F.col(p.query_id).alias(self.query_id), F.col(p.item_id).alias(self.item_id), "score", "rank") for p in self.parts]
        merged = rerank.ensemble(found, self.weights, self.query_id, self.item_id, self.method)
        return _kept(ranking.top_k(merged, self.query_id, self.item_id, k), self.item_id, threshold, where)


KINDS: dict[str, Callable[..., Retriever]] = {"vector": VectorRetriever, "keyword": KeywordRetriever, "hybrid": HybridRetriever, "contextual": ContextualRetriever, "multi_stage": MultiStageRetriever, "ensemble": EnsembleRetriever}


def create_retriever(kind: str = "vector", **options) -> Retriever:
    """A retriever by kind; an unknown kind or missing parts raise a ValueError."""
    if kind not in KINDS:
        raise ValueError(f"unknown retriever {kind}; known are {', '.join(KINDS)}")
    try:
        return KINDS[kind](**options)
    except TypeError as e:
        raise ValueError(f"options of a {kind} retriever: {e}") from e


def items_where(rows: DataFrame, item: str, condition: Column) -> DataFrame:
    """The items a metadata condition holds for, as ``retrieve`` takes them."""
    return rows.where(condition).select(item)

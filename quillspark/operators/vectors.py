"""Vector search: exact k-NN by blocks of queries, and store maintenance; approximate search is in ``proximity``.

Queries travel to the vectors in blocks of bounded size; each task multiplies its vectors by a block
with numpy and keeps its k best per query, so what is shuffled is k rows a query and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.vector import normalize
from quillspark.operators.ranking import top_k
from quillspark.session import shared_path

FOUND = "query_id long, id long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    """(rows, dim) doubles of a list column without nulls."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1.0, n)
        return unit(q) @ unit(x).T
    if metric == "dot":
        return q @ x.T
    if metric == "l2":
        return 1.0 / (1.0 + np.maximum(0.0, (q * q).sum(1)[:, None] - 2.0 * q @ x.T + (x * x).sum(1)[None, :]))
    raise ValueError(f"unknown metric {metric}")


def _best(ids: np.ndarray, scores: np.ndarray, queries: list[int], k: int) -> pa.RecordBatch:
    out_q, out_i, out_s = [], [], []
    for n, q in enumerate(queries):
        order = np.lexsort((ids, -np.round(scores[n], 6)))[:k]
        out_q += [q] * len(order)
        out_i.append(ids[order])
        out_s.append(scores[n][order])
    cat = lambda parts: np.concatenate(parts) if parts else np.empty(0)
    return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(cat(out_i).astype(np.int64)), pa.array(cat(out_s).astype(np.float64))], ["query_id", "id", "score"])


def query_blocks(queries: DataFrame, id_col: str, vec_col: str, block: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Blocks of at most ``block`` queries; the driver holds one at a time."""
    ids, rows = [], []
    for r in queries.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null").toLocalIterator(prefetchPartitions=True):
        ids.append(r.i)
        rows.append(r.v)
        if len(ids) >= block:
            yield ids, np.array(rows)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows)


def _written(found: DataFrame, shared: Broadcast) -> DataFrame:
    """The rows of a block of queries, written out, so that one block is held at a time."""
    path = shared_path(found.sparkSession, "knn")
    found.write.parquet(path)
    shared.destroy()
    return found.sparkSession.read.parquet(path)


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "vec_id", query_col: str = "embedding", where: Column | None = None, threshold: float | None = None, block: int = 2048, part: int = 1024) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest vectors, exact. ``where`` filters vectors before the search; ``threshold`` drops scores below it."""
    spark = vectors.sparkSession
    source = vectors.where(where) if where is not None else vectors
    rows = source.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null")

    def passes(ids: list[int], matrix: np.ndarray) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            held, least = None, np.full((len(names), 1), -np.inf)
            # Batches are cut, so that what is compared at once has a bounded size; only what may be among a query's k best is put in order.
            for b in (b.slice(at, part) for b in batches for at in range(0, b.num_rows, part)):
                scores = _scores(_matrix(b.column(1)), q, metric)
                own, row = np.nonzero(~(scores < least - 1e-6))
                now = [own, np.asarray(b.column(0))[row], scores[own, row]]
                if held is not None:
                    now = [np.concatenate(x) for x in zip(held, now, strict=True)]
                main = np.round(now[2], 6)
                order = np.lexsort((now[1], -main, now[0]))
                sorted_own = now[0][order]
                place = np.arange(len(order)) - np.searchsorted(sorted_own, sorted_own)
                least[sorted_own[place == k - 1], 0] = main[order[place == k - 1]]
                held = [x[order[place < k]] for x in now]
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "id", "score"])

        return rows.mapInArrow(run, FOUND), shared

    found: list[DataFrame] = []
    last = None
    for b in query_blocks(queries, query_id, query_col, block):
        found += [_written(*last)] if last else []
        last = passes(*b)
    if last:
        found.append(_written(*last) if found else last[0])
    best = top_k(reduce(DataFrame.union, found) if found else spark.createDataFrame([], FOUND), "query_id", "id", k)
    return best if threshold is None else best.where(F.col("score") >= threshold)


def add_vectors(store: DataFrame, new: DataFrame, vec_col: str = "embedding", unit: bool = True) -> DataFrame:
    """Appends rows, normalised for cosine search."""
    return store.unionByName(new.withColumn(vec_col, normalize(vec_col).cast(store.schema[vec_col].dataType)) if unit else new, allowMissingColumns=True)


def delete_vectors(store: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return store.join(ids.select(id_col).distinct(), id_col, "left_anti")


def store_stats(store: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Vectors, their dimension, and bytes as 4-byte floats."""
    size = F.size(vec_col).cast("long")
    return store.agg(F.count("*").alias("n_vectors"), F.max(size).alias("dimension"), F.coalesce(F.sum(size * 4), F.lit(0)).alias("n_bytes"))


def search_parameters(n: Column) -> Column:
    """Cells probed by size of the store: more rows, wider search."""
    return F.when(n < 10_000, 64).when(n < 100_000, 128).otherwise(256).cast("long")

"""BERTScore: greedy alignment of token vectors of a candidate and a reference, weighted by inverse document frequency."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import metric_tokens

Encoder = Callable[[list[str]], np.ndarray]


def hashed_tokens(dim: int = 64) -> Encoder:
    """A deterministic encoder: each token's vector comes from its letter trigrams and those of its neighbours, a quarter as heavy."""
    import xxhash

    def encode(tokens: list[str]) -> np.ndarray:
        own = np.zeros((len(tokens), dim))
        for n, t in enumerate(tokens):
            padded = f"<{t}>"
            for k in range(len(padded) - 2):
                h = xxhash.xxh64_intdigest(padded[k : k + 3])
                own[n, h % dim] += 1.0 if h >> 63 else -1.0
        out = own.copy()
        out[1:] += 0.25 * own[:-1]
        out[:-1] += 0.25 * own[1:]
        return out

    return encode


def greedy(c: np.ndarray, r: np.ndarray, cw: np.ndarray, rw: np.ndarray, block: int = 512) -> tuple[float, float, float]:
    """(precision, recall, f1): each token's best cosine on the other side, averaged by weight; 0 where a side has no token or no weight."""
    if not len(c) or not len(r) or cw.sum() <= 0 or rw.sum() <= 0:
        return 0.0, 0.0, 0.0
    c, r = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (np.asarray(c, np.float64), np.asarray(r, np.float64)))
    best_c, best_r = np.empty(len(c)), np.full(len(r), -np.inf)
    for at in range(0, len(c), block):  # a block of rows against all columns: the whole matrix is never held
        near = c[at : at + block] @ r.T
        best_c[at : at + block] = near.max(axis=1)
        best_r = np.maximum(best_r, near.max(axis=0))
    p, q = float(best_c @ cw / cw.sum()), float(best_r @ rw / rw.sum())
    return p, q, 2 * p * q / (p + q) if p + q > 0 else 0.0


def token_weights(pairs: DataFrame, id_col: str, candidate: str, reference: str, idf: bool = True) -> DataFrame:
    """(id, c, cw, r, rw): tokens of both texts and their weights, ln((N + 1) / (df + 1)) over the N references, or 1."""
    rows = pairs.select(F.col(id_col).alias("id"), metric_tokens(candidate).alias("c"), metric_tokens(reference).alias("r"))
    if not idf:
        ones = lambda c: F.transform(c, lambda _: F.lit(1.0))
        return rows.select("id", "c", ones("c").alias("cw"), "r", ones("r").alias("rw"))
    numbered = rows.withColumn("row", F.xxhash64("id", "c", "r"))
    df = rows.select(F.explode(F.array_distinct("r")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    tokens = numbered.select("row", F.lit("c").alias("side"), F.posexplode("c").alias("pos", "t")).union(numbered.select("row", F.lit("r"), F.posexplode("r"))).distinct()
    n = rows.agg(F.count("*").alias("n"))  # one row
    weight = F.log((F.col("n") + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0))
    weighted = tokens.join(df, "t", "left").join(F.broadcast(n)).groupBy("row", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", weight.alias("w")))), lambda x: x["w"]).alias("w"))
    none = F.array().cast("array<double>")
    side = lambda s: weighted.where(F.col("side") == s).select("row", F.col("w").alias(f"{s}w"))
    out = numbered.join(side("c"), "row", "left").join(side("r"), "row", "left")
    return out.select("id", "c", F.coalesce("cw", none).alias("cw"), "r", F.coalesce("rw", none).alias("rw"))


def bert_score(pairs: DataFrame, id_col: str, candidate: str, reference: str, encode: Encoder, idf: bool = True, block: int = 512) -> DataFrame:
    """(id, precision, recall, f1) of every pair; ``encode`` gives a row of numbers for each token of one text and is loaded where it runs."""
    rows = token_weights(pairs, id_col, candidate, reference, idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for c, cw, r, rw in zip(*(b.column(k).to_pylist() for k in ("c", "cw", "r", "rw")), strict=True):
                scores.append(greedy(encode(c), encode(r), np.array(cw), np.array(rw), block) if c and r else (0.0, 0.0, 0.0))
            yield pa.RecordBatch.from_arrays([b["id"], *(pa.array([s[k] for s in scores], pa.float64()) for k in range(3))], [id_col, "precision", "recall", "f1"])

    return rows.mapInArrow(run, f"`{id_col}` {pairs.schema[id_col].dataType.simpleString()}, precision double, recall double, f1 double")

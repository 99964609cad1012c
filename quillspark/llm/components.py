"""Connected components of an edge list by alternating large and small stars, all in joins and partial aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize


def _lowest(edges: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """Each edge (u, v) with the smallest of u and its neighbours.

    The minima are written out first: AQE splits a node with many edges only in a join of two plain exchanges.
    """
    low = materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "lowest")
    spent.append(low)
    return edges.join(low, "u")


def _large_star(edges: DataFrame, spent: list[DataFrame]) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _lowest(both, spent).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, spent: list[DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down, spent)
    return low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node each node of ``edges`` can reach; nodes are long. Nodes without an edge have no row."""
    now = materialize(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        spent = [now]
        now = materialize(_small_star(_large_star(now, spent), spent), "stars")
        discard(*spent)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Forest:
    """Which of some labels are connected."""

    def __init__(self, labels: np.ndarray):
        self.label, self.root = labels, np.arange(int(labels.max()) + 1 if len(labels) else 0)

    def of(self, rows: np.ndarray) -> np.ndarray:
        return self.root[self.label[rows]]

    def connect(self, x: np.ndarray, y: np.ndarray) -> None:
        root = self.root
        for a, b in zip(self.label[x].tolist(), self.label[y].tolist(), strict=True):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        while (root[root] != root).any():
            root[:] = root[root]

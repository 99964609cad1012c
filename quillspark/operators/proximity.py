"""Approximate vector search: layered proximity graphs, and cells whose nearest are found through such a graph.

A layered graph (``build_graph``) is made for each shard of bounded size. Each vector has a level, drawn from a hash so that every
level holds one in ``m`` of the one below; on each level it is linked with near vectors that are nearer to it than to each other,
and these with it. Links are adjacency rows: a row holds a vector, its place in the shard and its neighbours' places
level by level. ``search_graph`` sends queries, in blocks, to every shard, climbs down the levels greedily and keeps the ``ef``
best on the lowest; each shard returns k rows a query, which are merged.

Cells (``CellIndex``) grow with the table up to ``max_cells``. Their centroids come from a bounded sample, moved by rounds of k-means
in which Spark adds up the vectors of each cell; the nearest cells of a vector are found through a graph over the centroids (or by comparing
with all of them). Rows are stored sorted by cell. A query reads its nearest cells only; large cells are cut into parts.

Rows without a vector or an id are left out; repeated ids are rows of their own. Empty tables give empty results; other columns are ignored.
Scores are those of exact search: cosine (a zero vector scores 0), dot, or 1 / (1 + squared distance) for l2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.ranking import top_k

FOUND = "query_id long, id long, score double"
FOUND_SCHEMA = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
GRAPH = "shard int, place int, id long, v array<float>, links array<array<int>>"


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """(rows, dim) of a list column without nulls."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten(), np.float32)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 1)


def units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def prepared(x: np.ndarray, metric: str) -> np.ndarray:
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric {metric}")
    return units(x) if metric == "cosine" else x


def offsets(x: np.ndarray, metric: str) -> np.ndarray:
    """What is taken off a product so that a larger difference means nearer."""
    return (x * x).sum(axis=1) / 2 if metric == "l2" else np.zeros(len(x), np.float32)


def scored(near: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Scores of differences: products less ``offsets``; ``q`` has the queries' squared lengths."""
    return 1.0 / (1.0 + np.maximum(0.0, q - 2.0 * near)) if metric == "l2" else near


def hashed_levels(n: int, m: int) -> np.ndarray:
    """Level of each of n rows: at least l for about one in m ** l."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    share = ((x >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.floor(-np.log(share) / np.log(m)).astype(np.int64)


def spread(x: np.ndarray, off: np.ndarray, near: np.ndarray, score: np.ndarray, own: int, most: int) -> list[int]:
    """Of ``near`` (best first), those nearer to ``own`` than to any taken before; the best of the rest fill up half the places."""
    taken: list[int] = []
    between = x[near] @ x[near].T - off[near][None, :]
    left = []
    for k in range(len(near)):
        if len(taken) >= most:
            break
        if taken and (between[k, taken] - off[near[k]] > score[k] - off[near[k]]).any():
            left.append(k)
        else:
            taken.append(k)
    taken += left[: max(0, most // 2 - len(taken))]
    return near[taken].tolist()


def level_links(x: np.ndarray, off: np.ndarray, most: int, candidates: int, block: int = 1024) -> list[list[int]]:
    """Neighbours of each row: nearest rows that are spread out, and rows that chose it."""
    n = len(x)
    chosen: list[list[int]] = []
    for at in range(0, n, block):
        near = x[at : at + block] @ x.T - off[None, :]
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        width = min(candidates, n - 1)
        if width < 1:
            chosen += [[] for _ in range(len(near))]
            continue
        top = np.argpartition(-near, width - 1, axis=1)[:, :width]
        score = np.take_along_axis(near, top, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        top, score = np.take_along_axis(top, order, 1), np.take_along_axis(score, order, 1)
        chosen += [spread(x, off, top[k], score[k], at + k, most) for k in range(len(near))]
    back: list[list[int]] = [[] for _ in range(n)]
    for k, own in enumerate(chosen):
        for other in own:
            back[other].append(k)
    out = []
    for k in range(n):
        both = np.array(sorted({*chosen[k], *back[k]}), np.int64)
        if len(both) > 2 * most:
            score = x[both] @ x[k] - off[both]
            both = np.concatenate([np.array(chosen[k], np.int64), both[np.argsort(-score, kind="stable")]])
            both = both[np.sort(np.unique(both, return_index=True)[1])][: 2 * most]
        out.append(both.tolist())
    return out


@dataclass
class Graph:
    """A shard's vectors and links: on level l, ``links[l]`` is (rows, width) of places, -1 where there is none."""

    ids: np.ndarray
    x: np.ndarray
    off: np.ndarray
    links: list[np.ndarray]
    entry: int

    @staticmethod
    def made(ids: np.ndarray, x: np.ndarray, metric: str, m: int, candidates: int) -> tuple[np.ndarray, list[list[list[int]]]]:
        """(order, links): rows by descending level, and each one's neighbours level by level."""
        levels = hashed_levels(len(ids), m)
        order = np.lexsort((np.arange(len(ids)), -levels))
        x, levels = x[order], levels[order]
        off = offsets(x, metric)
        links: list[list[list[int]]] = [[] for _ in range(len(ids))]
        for level in range(int(levels[0]) + 1 if len(levels) else 0):
            n = int((levels >= level).sum())
            for k, own in enumerate(level_links(x[:n], off[:n], m if level else 2 * m, candidates)):
                links[k].append(own)
        return order, links

    @staticmethod
    def of(ids: np.ndarray, x: np.ndarray, links: list[list[list[int]]], metric: str) -> Graph:
        levels = []
        for level in range(max(map(len, links), default=0)):
            own = [r[level] if len(r) > level else [] for r in links]
            wide = np.full((len(links), max(1, max(map(len, own)))), -1, np.int64)
            for k, r in enumerate(own):
                wide[k, : len(r)] = r
            levels.append(wide)
        return Graph(ids, x, offsets(x, metric), levels, 0)

    def search(self, q: np.ndarray, k: int, ef: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(places, differences) of the best rows of each query, best first; -1 and -inf where there are fewer."""
        parts = [self._search(q[at : at + block], k, max(ef, k)) for at in range(0, len(q), block)]
        return np.concatenate([p for p, _ in parts]), np.concatenate([s for _, s in parts])

    def _near(self, q: np.ndarray, places: np.ndarray) -> np.ndarray:
        at = np.maximum(places, 0)
        return np.where(places >= 0, np.einsum("qd,qwd->qw", q, self.x[at], optimize=True) - self.off[at], -np.inf)

    def _search(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows = len(q), np.arange(len(q))
        at = np.full(n, self.entry)
        best = self._near(q, at[:, None])[:, 0]
        for links in reversed(self.links[1:]):
            moving = rows
            while len(moving):
                near = links[at[moving]]
                score = self._near(q[moving], near)
                top = score.argmax(axis=1)
                better = score[np.arange(len(moving)), top] > best[moving]
                moving, to, by = moving[better], near[better, top[better]], score[better, top[better]]
                at[moving], best[moving] = to, by
        seen = np.zeros((n, len(self.x)), bool)
        seen[rows, at] = True
        places, scores = np.full((n, ef), -1), np.full((n, ef), -np.inf)
        places[:, 0], scores[:, 0] = at, best
        done = np.zeros((n, ef), bool)
        active = rows
        while len(active):
            # Each query opens its best row that is not open yet, and stops when there is none.
            open_score = np.where(done[active] | (places[active] < 0), -np.inf, scores[active])
            pick = open_score.argmax(axis=1)
            more = open_score[np.arange(len(active)), pick] > -np.inf
            active, pick = active[more], pick[more]
            if not len(active):
                break
            done[active, pick] = True
            near = self.links[0][places[active, pick]]
            near = np.where((near >= 0) & ~seen[active[:, None], np.maximum(near, 0)], near, -1)
            hit = near >= 0
            seen[np.broadcast_to(active[:, None], near.shape)[hit], near[hit]] = True
            score = self._near(q[active], near)
            all_places = np.concatenate([places[active], near], axis=1)
            all_scores = np.concatenate([scores[active], score], axis=1)
            all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
            keep = np.argsort(-all_scores, axis=1, kind="stable")[:, :ef]
            places[active], scores[active], done[active] = (np.take_along_axis(z, keep, 1) for z in (all_places, all_scores, all_done))
        return places[:, :k], scores[:, :k]


def vector_rows(vectors: DataFrame, id_col: str, vec_col: str, names: tuple[str, str] = ("id", "v")) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias(names[0]), F.col(vec_col).cast("array<float>").alias(names[1]))
    return rows.where((F.size(names[1]) > 0) & F.col(names[0]).isNotNull())


def build_graph(vectors: DataFrame, metric: str = "cosine", m: int = 16, candidates: int = 64, shard_rows: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Adjacency rows (shard, place, id, v, links) of one layered graph for each shard of about ``shard_rows`` vectors."""
    prepared(np.zeros((1, 1)), metric)
    rows = vector_rows(vectors, id_col, vec_col)
    # Row numbers of a scan are dealt out evenly, whatever the ids are.
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        ids, x = np.asarray(t["id"]), prepared(matrix(t["v"]), metric)
        order, links = Graph.made(ids, x, metric, m, candidates)
        v = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], np.ascontiguousarray(x[order], np.float32).reshape(-1))
        return pa.table([pa.array(np.repeat(np.asarray(t["shard"])[:1], len(x)), pa.int32()), pa.array(np.arange(len(x)), pa.int32()), t["id"].take(pa.array(order)), v, pa.array(links, pa.list_(pa.list_(pa.int32())))], names=["shard", "place", "id", "v", "links"])

    return dealt.groupBy("shard").applyInArrow(run, GRAPH)


def save_graph(graph: DataFrame, path: str, metric: str = "cosine") -> None:
    """Stores a graph; its metric goes with every row."""
    graph.withColumn("metric", F.lit(metric)).write.parquet(path)


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def query_blocks(queries: DataFrame, query_id: str, query_col: str, block: int) -> tuple[DataFrame, int]:
    """Queries with the number of their block, and how many blocks there are."""
    rows = vector_rows(queries, query_id, query_col, ("query_id", "q"))
    blocks = max(1, -(-rows.count() // block))
    return rows.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), blocks


def found_table(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
    """Rows of (queries, k) ids and scores, -inf where there is none."""
    real = np.isfinite(scores)
    return pa.table([pa.array(np.repeat(queries, scores.shape[1]).reshape(scores.shape)[real], pa.int64()), pa.array(ids[real], pa.int64()), pa.array(scores[real], pa.float64())], schema=FOUND_SCHEMA)


def nearest_within(vectors: DataFrame, queries: DataFrame, group: str, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", part_rows: int = 8192, block: int = 20_000) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors of the query's own group, exact, in one job for all groups; rows without a group meet none."""
    rows = vectors.select(F.col(group).alias("group"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("size(v) > 0 AND id IS NOT NULL AND group IS NOT NULL")
    asked = queries.select(F.col(group).alias("group"), F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<float>").alias("q")).where("size(q) > 0 AND query_id IS NOT NULL AND group IS NOT NULL")
    blocks = max(1, -(-asked.count() // block))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    return grouped_search(rows, dealt, "group", k, metric, rows.groupBy("group").agg(F.count("*").alias("n")), blocks, part_rows)


def search_graph(graph: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", ef: int = 100, block: int = 20_000, query_id: str = "vec_id", query_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): about the k nearest vectors of each query, from every shard of the graph; a larger ``ef`` finds more of them."""
    asked, blocks = query_blocks(queries, query_id, query_col, block)
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
    shards = graph.select(F.col("shard").alias("to")).distinct().withColumn("block", F.explode(numbers))
    to = shards.join(asked, "block")

    def run(g: pa.Table, q: pa.Table) -> pa.Table:
        if not len(g) or not len(q):
            return FOUND_SCHEMA.empty_table()
        g = g.sort_by("place")
        x, ids = matrix(g["v"]), np.asarray(g["id"])
        asked = prepared(matrix(q["q"]), metric)
        places, near = Graph.of(ids, x, g["links"].to_pylist(), metric).search(asked, k, ef)
        scores = scored(near.astype(np.float64), (asked * asked).sum(axis=1)[:, None], metric)
        return found_table(np.asarray(q["query_id"]), ids[np.maximum(places, 0)], np.where(places >= 0, scores, -np.inf))

    spread_out = graph.select("shard", "place", "id", "v", "links").withColumn("block", F.explode(numbers))
    met = spread_out.groupBy("shard", "block").cogroup(to.groupBy("to", "block")).applyInArrow(run, FOUND)
    return top_k(met, "query_id", "id", k)


def grouped_search(rows: DataFrame, asked: DataFrame, group: str, k: int, metric: str, sizes: DataFrame, blocks: int = 1, part_rows: int = 8192) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of the ``rows`` (group, id, v) in the groups that ``asked`` (group, block, query_id, q) names.

    Groups of more than ``part_rows`` rows (``sizes`` has each one's n) are cut into parts, each of which returns k rows a query.
    """
    parts = F.ceil(F.col("n") / part_rows).cast("int")
    to = asked.join(sizes, group).withColumn("in_part", F.explode(F.sequence(F.lit(0), parts - 1))).select(F.col(group).alias("in_group"), "in_part", "block", "query_id", "q")
    held = rows.join(sizes, group).withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("in_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(group, "part", "in_block", "id", "v")

    def run(t: pa.Table, q: pa.Table) -> pa.Table:
        if not len(t) or not len(q):
            return FOUND_SCHEMA.empty_table()
        x, queries = (prepared(matrix(c).astype(np.float64), metric) for c in (t["v"], q["q"]))
        ids = np.asarray(t["id"])
        found = []
        for at in range(0, len(queries), 1024):
            some = queries[at : at + 1024]
            near = some @ x.T - offsets(x, metric)[None, :]
            top = np.argsort(-near, axis=1, kind="stable")[:, :k]
            scores = scored(np.take_along_axis(near, top, 1), (some * some).sum(axis=1)[:, None], metric)
            found.append(found_table(np.asarray(q["query_id"])[at : at + 1024], ids[top], scores))
        return pa.concat_tables(found)

    met = held.groupBy(group, "part", "in_block").cogroup(to.groupBy("in_group", "in_part", "block")).applyInArrow(run, FOUND)
    return top_k(met, "query_id", "id", k)


class CellIndex:
    """Vectors stored by cell. ``coarse`` says how a vector's nearest cells are found: ``graph`` through a graph over the centroids, ``flat`` by comparing with all.

    Centroids are at most ``max_cells``; they are what the driver and each task hold whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        head = spark.read.parquet(f"{path}/centroids").orderBy("place").toArrow()  # at most max_cells rows
        self.spark, self.path = spark, path
        self.metric, self.coarse = head["metric"][0].as_py(), head["coarse"][0].as_py()
        self.quantizer = Graph.of(np.asarray(head["id"]), matrix(head["v"]), head["links"].to_pylist(), self.metric)
        self.rows = spark.read.parquet(f"{path}/rows")
        self.sizes = spark.read.parquet(f"{path}/sizes")

    @staticmethod
    def nearest(quantizer: Graph, x: np.ndarray, k: int, ef: int, coarse: str) -> np.ndarray:
        """(rows, k) numbers of the nearest cells, best first."""
        k = min(k, len(quantizer.ids))
        if coarse == "graph":
            places, _ = quantizer.search(x, k, max(ef, 2 * k))
        else:
            near = [x[at : at + 1024] @ quantizer.x.T - quantizer.off[None, :] for at in range(0, len(x), 1024)]
            places = np.concatenate([np.argsort(-part, axis=1, kind="stable")[:, :k] for part in near]) if near else np.empty((0, k), np.int64)
        return np.where(places >= 0, quantizer.ids[np.maximum(places, 0)], -1)

    @staticmethod
    def build(vectors: DataFrame, path: str, metric: str = "cosine", coarse: str = "graph", cell_rows: int = 1000, max_cells: int = 65_536, train_rows: int = 1_000_000, rounds: int = 5, m: int = 16, ef: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> CellIndex:
        """Writes an index of about ``cell_rows`` vectors a cell to ``path``: centroids fitted on about ``train_rows`` rows, and all rows by cell."""
        spark = vectors.sparkSession
        rows = vector_rows(vectors, id_col, vec_col)
        n = rows.count()
        cells = min(max_cells, max(1, -(-n // cell_rows)))
        order = F.xxhash64("id", "v", F.lit(7))
        start = rows.orderBy(order, "id").limit(cells).select("v").toArrow()
        centroids = prepared(matrix(start["v"]), metric)
        train = rows if n <= train_rows else rows.where(F.pmod(order, F.lit(1 << 30)) < (train_rows << 30) // n)
        for _ in range(rounds if len(centroids) else 0):
            centroids = CellIndex._moved(train, centroids, metric, coarse, m, ef)
        placed, links = Graph.made(np.arange(len(centroids)), centroids, metric, m, 64)
        head = [(k, int(placed[k]), centroids[placed[k]].tolist(), links[k], metric, coarse) for k in range(len(centroids))]
        spark.createDataFrame(head, "place int, id long, v array<float>, links array<array<int>>, metric string, coarse string").coalesce(1).write.parquet(f"{path}/centroids")
        if not head:
            spark.createDataFrame([(0, 0, [], [], metric, coarse)], "place int, id long, v array<float>, links array<array<int>>, metric string, coarse string").write.mode("overwrite").parquet(f"{path}/centroids")
        quantizer = Graph.of(placed, centroids[placed], links, metric)
        # AQE splits what a large cell would make of one partition.
        CellIndex._assigned(rows, quantizer, metric, coarse, ef).hint("rebalance", "cell").sortWithinPartitions("cell", "id").write.parquet(f"{path}/rows")
        spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n")).write.parquet(f"{path}/sizes")
        return CellIndex(spark, path)

    @staticmethod
    def _assigned(rows: DataFrame, quantizer: Graph, metric: str, coarse: str, ef: int) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(quantizer)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = CellIndex.nearest(shared.value, prepared(matrix(b["v"]), metric), 1, ef, coarse)[:, 0] if len(b) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), b["id"], b["v"]], ["cell", "id", "v"])

        return rows.mapInArrow(run, "cell long, id long, v array<float>")

    @staticmethod
    def _moved(train: DataFrame, centroids: np.ndarray, metric: str, coarse: str, m: int, ef: int) -> np.ndarray:
        """Means of the training rows nearest to each centroid; one without rows stays."""
        placed, links = Graph.made(np.arange(len(centroids)), centroids, metric, m, 64)
        assigned = CellIndex._assigned(train, Graph.of(placed, centroids[placed], links, metric), metric, coarse, ef)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros(centroids.shape), np.zeros(len(centroids), np.int64)
            for b in batches:
                if len(b):
                    np.add.at(sums, np.asarray(b["cell"]), prepared(matrix(b["v"]), metric))
                    n += np.bincount(np.asarray(b["cell"]), minlength=len(n))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(list(sums[at]), pa.list_(pa.float64()))], ["cell", "n", "s"])

        def total(t: pa.Table) -> pa.Table:
            return pa.table([t["cell"].slice(0, 1), pa.array([matrix(t["s"]).astype(np.float64).sum(axis=0) / sum(t["n"].to_pylist())], pa.list_(pa.float64()))], names=["cell", "v"])

        means = assigned.mapInArrow(partial, "cell long, n long, s array<double>").groupBy("cell").applyInArrow(total, "cell long, v array<double>").toArrow()
        out = centroids.copy()
        out[np.asarray(means["cell"])] = prepared(matrix(means["v"]), metric)
        return out

    def probes(self, probe: int, ef: int):
        """Rows (block, query_id, q) -> (cell, block, query_id, q) of the ``probe`` nearest cells of each query."""
        shared, metric, coarse = self.spark.sparkContext.broadcast(self.quantizer), self.metric, self.coarse

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A query comes out once for each of its cells, so few queries are taken at a time.
            step = max(1, 16_384 // max(1, probe))
            for b in (b.slice(at, step) for b in batches for at in range(0, len(b), step)):
                cells = CellIndex.nearest(shared.value, prepared(matrix(b["q"]), metric), probe, ef, coarse) if len(shared.value.ids) else np.empty((0, 1), np.int64)
                take = pa.array(np.repeat(np.arange(len(cells)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1), pa.int64()), *(b[c].take(take) for c in ("block", "query_id", "q"))], ["cell", "block", "query_id", "q"])

        return run

    def search(self, queries: DataFrame, k: int, probe: int = 10, ef: int = 64, part_rows: int = 8192, block: int = 20_000, query_id: str = "vec_id", query_col: str = "embedding") -> DataFrame:
        """(query_id, id, score, rank): about the k nearest vectors of each query, from its ``probe`` nearest cells."""
        asked, blocks = query_blocks(queries, query_id, query_col, block)
        near = asked.select("block", "query_id", "q").mapInArrow(self.probes(probe, ef), "cell long, block int, query_id long, q array<float>")
        return grouped_search(self.rows, near, "cell", k, self.metric, self.sizes, blocks, part_rows)

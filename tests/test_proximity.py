"""Approximate search against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import proximity, vectors
from quillspark.session import shared_path

EMBEDDINGS = "/root/testdata/sf0.1/embeddings.parquet"


def recall(found, exact):
    pairs = exact.select("query_id", "id")
    return pairs.join(found.select("query_id", "id"), ["query_id", "id"]).count() / pairs.count()


def clustered(spark, n=3000, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim)) * 3
    x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim))
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_graph_finds_most_of_the_exact_neighbours(spark, metric):
    rows = clustered(spark)
    asked = rows.where("vec_id % 20 = 0")
    graph = proximity.build_graph(rows, metric, shard_rows=800)
    assert graph.select("shard").distinct().count() == 4
    found = proximity.search_graph(graph, asked, 10, metric)
    exact = vectors.knn(rows, asked, 10, metric)
    assert recall(found, exact) >= 0.95
    both = found.join(exact.withColumnRenamed("score", "right"), ["query_id", "id"])
    assert both.where(F.abs(F.col("score") - F.col("right")) > 1e-4 * (1 + F.abs("right"))).count() == 0


def test_stored_graph_of_the_table_in_blocks_of_queries(spark):
    rows = spark.read.parquet(EMBEDDINGS)
    asked = rows.where("vec_id % 20 = 0")
    path = shared_path(spark, "graph")
    proximity.save_graph(proximity.build_graph(rows, shard_rows=2000), path)
    graph = proximity.load_graph(spark, path)
    assert graph.count() == rows.count()
    found = proximity.search_graph(graph, asked, 10, block=100)
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0
    assert recall(found, vectors.knn(rows, asked, 10)) >= 0.9


def test_graph_levels_and_links(spark):
    rows = proximity.build_graph(clustered(spark), shard_rows=10_000).collect()
    assert [r.place for r in sorted(rows, key=lambda r: r.place)] == list(range(3000))
    levels = [len(r.links) for r in rows]
    assert 1 < max(levels) <= 6 and sum(x > 1 for x in levels) < 3000 / 8
    for r in rows:
        for level, near in enumerate(r.links):
            assert len(near) <= (64 if level == 0 else 32) and r.place not in near and len(set(near)) == len(near)


@pytest.mark.parametrize("coarse", ["graph", "flat"])
@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_cells_find_most_of_the_exact_neighbours(spark, coarse, metric):
    rows = clustered(spark)
    asked = rows.where("vec_id % 20 = 0")
    index = proximity.CellIndex.build(rows, shared_path(spark, "cells"), metric, coarse, cell_rows=50, rounds=3)
    assert len(index.quantizer.ids) == 60 and index.rows.count() == 3000
    found = index.search(asked, 10, probe=12, part_rows=40, block=60)
    assert recall(found, vectors.knn(rows, asked, 10, metric)) >= 0.9
    # A loaded index answers the same, and all cells together are exact search.
    again = proximity.CellIndex(spark, index.path)
    assert again.search(asked, 10, probe=12).select("query_id", "id").exceptAll(found.select("query_id", "id")).count() == 0
    assert recall(again.search(asked, 10, probe=60, ef=200), vectors.knn(rows, asked, 10, metric)) >= 0.999


def test_cells_grow_with_the_table(spark):
    rows = clustered(spark, 1200)
    sizes = [len(proximity.CellIndex.build(rows.limit(n), shared_path(spark, "cells"), cell_rows=100, rounds=1).quantizer.ids) for n in (300, 1200)]
    assert sizes == [3, 12]


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, None, "b"), (None, [0.0, 1.0], "c"), (3, [0.0, 0.0], "d"), (4, [], "e")], "vec_id long, embedding array<double>, shard string")
    asked = spark.createDataFrame([(9, [1.0, 0.1]), (8, None)], "vec_id long, embedding array<double>")
    found = proximity.search_graph(proximity.build_graph(rows), asked, 5).collect()
    assert sorted((r.query_id, r.id) for r in found) == [(9, 1), (9, 1), (9, 3)]
    cells = proximity.CellIndex.build(rows, shared_path(spark, "cells"), cell_rows=1).search(asked, 5, probe=3).collect()
    assert sorted((r.query_id, r.id) for r in cells) == [(9, 1), (9, 1), (9, 3)]
    empty = rows.limit(0)
    assert proximity.search_graph(proximity.build_graph(empty), asked, 5).count() == 0
    assert proximity.CellIndex.build(empty, shared_path(spark, "cells")).search(asked, 5).count() == 0
    with pytest.raises(ValueError):
        proximity.build_graph(rows, "manhattan")

import random

from quillspark.llm.components import components


def test_chains_stars_and_single_edges(spark):
    rng = random.Random(3)
    chain = list(range(1000, 1120))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:], strict=False), *((7, k) for k in range(-200, 7)), (500, 501), (501, 500), (600, 600)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {k: 1000 for k in chain} | {k: -200 for k in range(-200, 8)} | {500: 500, 501: 500}
    assert got == want


def test_empty_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []

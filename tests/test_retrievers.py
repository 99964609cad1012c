"""Retrievers behind the factory, reranked rankings, response processing and the smaller evaluators."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluation, keyword, proximity, ranking, rerank, responses, retrievers
from quillspark.session import shared_path

DOCS = [(1, "red apples and green pears"), (2, "green tea with lemon"), (3, "red wine"), (4, "lemon cake with apples"), (5, None)]


@pytest.fixture(scope="module")
def index(spark):
    return keyword.build_index(spark.createDataFrame(DOCS, "doc_id long, text string"))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "red apples", [1.0, 0.0]), (2, "lemon", [0.0, 1.0])], "item_id long, text string, embedding array<double>")


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [0.7, 0.7]), (4, [-1.0, 0.0])], "vec_id long, embedding array<double>")


def ids(found, q):
    return [r.doc_id for r in sorted(found.where(F.col("item_id") == q).collect(), key=lambda r: r["rank"])]


def test_kinds_answer_alike(spark, index, queries, store):
    word = retrievers.create_retriever("keyword", index=index, k=3)
    near = retrievers.create_retriever("vector", store=store, k=3, query_id="item_id", item_id="doc_id")
    cells = proximity.CellIndex.build(store, shared_path(spark, "cells"), cell_rows=1, rounds=1)
    approximate = retrievers.create_retriever("vector", store=cells, k=3, query_id="item_id", item_id="doc_id", probe=4)
    hybrid = retrievers.create_retriever("hybrid", parts=[near, word], weights=[7, 3], k=3)
    both = retrievers.create_retriever("ensemble", parts=[near, word], k=3)
    rescored = retrievers.create_retriever("multi_stage", first=word, second=lambda q, found: found.withColumn("score", -F.col("doc_id").cast("double")), k=2)
    for r in (word, near, approximate, hybrid, both, rescored):
        found = r.retrieve(queries)
        assert found.columns == ["item_id", "doc_id", "score", "rank"]
    assert ids(word.retrieve(queries), 1)[0] == 1 and set(ids(word.retrieve(queries), 2)) == {2, 4}
    assert ids(near.retrieve(queries), 1) == ids(approximate.retrieve(queries), 1) == [1, 3, 2]
    assert ids(hybrid.retrieve(queries), 1)[0] == 1 and hybrid.weights == [0.7, 0.3]
    assert ids(rescored.retrieve(queries), 2) == [2, 4]
    # Filters come after the cut; a limit of its own goes with a call.
    assert ids(near.retrieve(queries, 2, where=store.select(F.col("vec_id").alias("doc_id")).where("doc_id = 2")), 1) == []
    assert ids(near.retrieve(queries, 1), 2) == [2] and ids(near.retrieve(queries, threshold=0.99), 1) == [1]
    assert retrievers.items_where(store, "vec_id", F.col("vec_id") > 2).count() == 2


def test_context_goes_in_front_of_queries(spark, index, queries):
    history = spark.createDataFrame([(2, "user: red wine")], "item_id long, history string")
    r = retrievers.create_retriever("contextual", base=retrievers.create_retriever("keyword", index=index, k=4), history=history)
    assert set(ids(r.retrieve(queries), 2)) == {1, 2, 3, 4} and ids(r.retrieve(queries), 1)[0] == 1


def test_reranker_within_the_hybrid(index, queries):
    parts = [retrievers.create_retriever("keyword", index=index, method=m) for m in ("bm25", "tfidf")]
    last = lambda q, best: best.where("rank >= 2").withColumn("score", F.lit(9.0))
    plain, turned = (retrievers.create_retriever("hybrid", parts=parts, k=3, reranker=x).retrieve(queries) for x in (None, last))
    assert sorted(ids(plain, 1)) == sorted(ids(turned, 1)) and ids(turned, 1)[-1] == ids(plain, 1)[0]


@pytest.mark.parametrize("kind, options", [("unknown", {}), ("vector", {}), ("keyword", {"index": None, "method": "odd"}), ("ensemble", {"parts": [], "weights": [0.0]}), ("ensemble", {"parts": [], "weights": [-1.0, 2.0]})])
def test_wrong_options_raise(spark, kind, options, index):
    with pytest.raises(ValueError):
        retrievers.create_retriever(kind, **({**options, "index": index} if "index" in options else options))


def test_weights():
    assert retrievers.shares([0.7, 0.305]) == [0.7, 0.305] and retrievers.shares([3, 1]) == [0.75, 0.25]


def test_spliced_keeps_ids_and_order(spark):
    ranked = spark.createDataFrame([(1, 10, 0.9, 1), (1, 20, 0.8, 2), (1, 30, 0.7, 3), (1, 40, 0.6, 4)], "q long, i long, score double, rank long")
    again = spark.createDataFrame([(1, 30, 0.2), (1, 20, 0.1), (1, 99, 5.0)], "q long, i long, score double")
    assert [(r.i, r["rank"], r.score) for r in rerank.spliced(ranked, again, "q", "i").orderBy("rank").collect()] == [(30, 1, 0.2), (20, 2, 0.1), (10, 3, 0.9), (40, 4, 0.6)]
    assert ranking.top_k(rerank.spliced(ranked, again.limit(0), "q", "i"), "q", "i", None).orderBy("rank").first().i == 10


# --- evaluators


def plain_ndcg(relevant, scores, k, first):
    dcg = sum(s / math.log2(n + 2) for n, (i, s) in enumerate(zip(relevant[:k], scores[:k], strict=False)) if i in first)
    order = sorted(relevant, key=lambda x: scores[relevant.index(x)] if x < len(scores) else 0, reverse=True)
    ideal = sum(scores[x] / math.log2(n + 2) for n, x in enumerate(order[:k]) if x < len(scores))
    return dcg / ideal if ideal > 0 else 0.0


def test_score_based_ndcg(spark):
    rows = [(1, [0, 2, 1], [0.5, 0.9, 0.1]), (2, [1, 0], [0.3, 0.8, 0.4]), (3, [2, 5, 0], [0.1, 0.7, 0.6]), (4, [], [0.5]), (5, [0], []), (6, [1, 3], [0.2, 0.2, 0.9, 0.4])]
    df = spark.createDataFrame(rows, "q long, rel array<long>, sc array<double>")
    for k in (1, 2, 5):
        first = spark.createDataFrame([(rows[0][1],)], "items array<long>")
        got = {r.q: r.ndcg for r in evaluation.score_ndcg(df, "rel", "sc", k, first).collect()}
        assert got == {q: pytest.approx(plain_ndcg(rel, sc, k, rows[0][1])) for q, rel, sc in rows}
        own = {r.q: r.ndcg for r in evaluation.score_ndcg(df, "rel", "sc", k).collect()}
        assert own == {q: pytest.approx(plain_ndcg(rel, sc, k, rel)) for q, rel, sc in rows}


def test_single_pairs(spark):
    df = spark.createDataFrame([(0.7, True), (0.7, False), (0.2, None), (0.5, True)], "score double, truth boolean")
    rows = evaluation.judged_pairs(df, "score", 0.5, "truth").collect()
    assert [(r.is_relevant, r.correct) for r in rows] == [(True, True), (True, False), (False, None), (True, True)]
    assert [round(r.confidence, 6) for r in rows] == [0.6, 0.6, 0.4, 1.0]
    assert "correct" not in evaluation.judged_pairs(df, "score").columns


def test_faithfulness_by_method(spark):
    df = spark.createDataFrame([("red apples grow", "red apples grow here"), (None, "x"), ("blue sky", "green grass")], "g string, s string")
    token = evaluation.faithfulness(df, "g", "s", "token").collect()
    assert [r.faithful for r in token] == [True, False, False] and token[0].score == pytest.approx(6 / 7)
    nli = lambda g, s: F.when(F.contains(s, g), 0.9).otherwise(0.2)
    both = evaluation.faithfulness(df, "g", "s", scorers={"nli": nli}).collect()
    assert both[0].score == pytest.approx((0.5 * 0.9 + 0.2 * 6 / 7) / 0.7) and both[0].nli_score == 0.9
    assert both[0].confidence == pytest.approx(1 - abs(0.9 - 6 / 7) / 2)
    for method in ("nli", "odd"):
        with pytest.raises(ValueError):
            evaluation.faithfulness(df, "g", "s", method)


def test_consistency(spark):
    df = spark.createDataFrame([("a", "a b"), ("c", "a b")], "g string, c string")
    entail = lambda c, g: F.struct(F.when(F.contains(c, g), "ENTAILMENT").otherwise("NEUTRAL").alias("label"), F.lit(0.8).alias("p"))
    assert [round(r.consistency, 6) for r in evaluation.consistency(df, "g", "c", entail).collect()] == [0.8, 0.2]
    samples = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (2, "x")], "i long, t string")
    assert {r.i: round(r.consistency, 6) for r in evaluation.self_consistency(samples, "i", "t").collect()} == {1: 0.333333, 2: 1.0}


def test_responses_are_processed_whole(spark):
    rows = [(1, "<think>no</think>According to the manual, it  works .", "ctx", ["The Manual", "other"], None), (2, None, None, None, "json"), (3, "- one\n- two", None, [], None), (4, "I think maybe 50% always. [Source: doc]", None, None, "table")]
    df = spark.createDataFrame(rows, "i long, r string, c string, known array<string>, want string")
    got = {r.i: r for r in responses.processed(df, "r", "c", "known", "want").collect()}
    assert (got[1].cleaned, got[1].format, got[1].sources) == ("According to the manual, it works.", "text", ["manual"])
    assert (got[2].cleaned, got[2].format, got[2].confidence, got[2].has_hallucination, got[2].sources) == ("", "json", 0.0, False, [])
    assert got[3].format == "bullet_points" and got[3].sources == [] and got[4].format == "table" and got[4].sources == ["doc"]
    with_context = responses.processed(df.withColumn("c", F.lit("given")), "r", "c").where("i = 3").first()
    assert with_context.confidence == pytest.approx(got[3].confidence + 0.2)


def test_responses_with_accents_are_scored_as_sql_does(spark, tmp_path):
    import duckdb

    from quillspark.plans import registry

    spark.createDataFrame([(1, 1, "user", "Esciónall í none, ñalways never. Été12% ok"), (1, 2, "assistant", "ball none"), (2, 1, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for name in ("hallucination", "process_responses"):
        got = registry.queries()[name](spark, str(tmp_path))
        want = con.sql(registry.oracle_sql()[name])
        assert sorted(map(repr, map(tuple, got.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))

"""Hand-checked values and edge cases of single operators."""

import math
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text, vector
from quillspark.operators import analytics, chunking, evaluation, expansion, keyword, prompts, proximity, ranking, rerank, services, vectors
from quillspark.sources import readers


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_reciprocal_rank_recall_and_precision(spark):
    relevant = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], "q long, i long")
    ranked = spark.createDataFrame([(0, 0, 1), (0, 2, 2), (0, 1, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3)], "q long, i long, rank long")
    rows = evaluation.per_query(evaluation.judged(ranked, relevant, "q", "i"), "q", [2])
    assert evaluation.means(rows, ranked, "q").first().rr == pytest.approx(0.75)
    relevant = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2)], "q long, i long")
    ranked = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 3, 3), (1, 1, 1), (1, 0, 2), (1, 2, 3)], "q long, i long, rank long")
    m = evaluation.means(evaluation.per_query(evaluation.judged(ranked, relevant, "q", "i"), "q", [2]), ranked, "q").first()
    assert m.recall_2 == pytest.approx((2 / 3 + 1 / 2) / 2) and m.precision_2 == pytest.approx(0.75)


def test_token_f1_and_bleu(spark):
    assert one(spark, evaluation.token_f1("a", "b"), a="one two three four", b="one two five six seven") == pytest.approx(400 / 9)
    assert one(spark, evaluation.token_f1("a", "b"), a="", b="") == 100.0
    same = "the cat sat on the mat".split()
    assert evaluation.bleu(same, same) == pytest.approx(100.0)
    assert 0 < evaluation.bleu("the cat sat".split(), same) < 100 and evaluation.bleu(["x"], same) == 0
    assert evaluation.rouge_l("a b c d".split(), "a x c d".split()) == pytest.approx(0.75)
    assert evaluation.meteor(same, same) == pytest.approx(1 - 0.5 / 6**3)


def test_normalisers(spark):
    df = spark.createDataFrame([(0, 0, 3.0), (0, 1, 3.0), (0, 2, 3.0), (1, 0, 0.2), (1, 1, 0.9), (1, 2, 0.5)], "q long, i long, score double")
    get = lambda m: {(r.q, r.i): r.score for r in ranking.normalize_scores(df, ["score"], "q", "i", m).collect()}
    assert [get("min_max")[0, i] for i in range(3)] == [1.0] * 3
    assert [round(get("rank")[1, i], 6) for i in range(3)] == [0.333333, 1.0, 0.666667]
    assert get("z_score")[0, 0] == 0.5 and get("sigmoid")[0, 0] == pytest.approx(1 / (1 + math.exp(-3)))
    assert sum(get("softmax")[1, i] for i in range(3)) == pytest.approx(1.0)


def test_reciprocal_rank_fusion(spark):
    a = spark.createDataFrame([(0, 5, 0.9), (0, 6, 0.5)], "q long, i long, score double")
    b = spark.createDataFrame([(0, 6, 0.8), (0, 5, 0.1)], "q long, i long, score double")
    got = {r.i: r.score for r in ranking.fuse([a, b], "q", "i", "rrf").collect()}
    assert got[5] == pytest.approx(0.5 / 61 + 0.5 / 62) == got[6]
    assert ranking.fuse([a, b], "q", "i", "max").count() == 2
    with pytest.raises(ValueError):
        ranking.fuse([a, b], "q", "i", "none")


def test_fixed_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "  "), (3, None), (4, "abcd")], "doc_id long, text string")
    rows = chunking.chunk(df, "fixed", size=4, overlap=1).collect()
    assert [(r.start_char, r.end_char, r.text) for r in rows if r.doc_id == 1] == [(0, 4, "abcd"), (3, 7, "defg"), (6, 10, "ghij")]
    assert {r.doc_id for r in rows} == {1, 4}


CODE = "intro words here. " * 8 + "\n```python\n" + "x = 1\n" * 30 + "```\nafter text. " * 6
MARKDOWN = "lead\n# One\nalpha beta\n```\n# not a header\n```\n## Two\n" + "gamma delta. " * 40


@pytest.mark.parametrize("strategy", sorted(chunking.STRATEGIES))
def test_chunks_cover_texts(spark, strategy):
    df = spark.createDataFrame([(1, CODE), (2, MARKDOWN), (3, ""), (4, "one"), (5, "word " * 700)], "doc_id long, text string")
    size, overlap = (3, 0) if strategy in ("sentence", "paragraph") else (120, 20)
    rows = chunking.chunk(df, strategy, size=size, overlap=overlap).collect()
    assert {r.doc_id for r in rows} == {1, 2, 4, 5}
    for i in (1, 2, 4, 5):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in own] == list(range(len(own)))
        if strategy in ("fixed", "recursive", "code", "markdown", "code_file", "adaptive"):
            source = {1: CODE, 2: MARKDOWN, 4: "one", 5: "word " * 700}[i]
            covered = set().union(*(range(r.start_char, r.end_char) for r in own))
            assert all(source[k].isspace() or k in covered for k in range(len(source)))


def test_markdown_sections_and_whole_fences(spark):
    df = spark.createDataFrame([(1, MARKDOWN)], "doc_id long, text string")
    headers = [r.header for r in chunking.chunk(df, "markdown", size=120, overlap=20).orderBy("chunk_index").collect()]
    assert headers[:2] == ["root", "One"] and set(headers[2:]) == {"Two"}
    pieces = list(chunking.code_pieces(CODE, 120, 20))
    fence = CODE.index("```"), CODE.rindex("```\nafter text. " * 1) + 3
    assert all(not (fence[0] < s < CODE.index("```", fence[0] + 3)) for s, _, _ in pieces)


def test_code_files_split_at_functions():
    source = "import x\n\ndef a():\n    return 1\n\nclass B:\n    def c(self):\n        pass\n\nvalue = 2\n"
    names = [h for _, _, h in chunking.code_file_pieces(source, 800, 0)]
    assert names == [None, "a", "B", None]


def test_bucket_and_assignment(spark):
    assert one(spark, analytics.bucket(F.col("k")), k="exp_1:42") == 7351
    assert analytics.variant_weights([("a", 2.0), ("b", 2.0)]) == [("a", 0.5), ("b", 0.5)]


def test_index_percentiles(spark):
    df = spark.createDataFrame([("m", float(k)) for k in range(1, 11)], "name string, value double")
    r = analytics.index_percentiles(df, "name", "value", [0.5, 0.95]).first()
    assert (r.n, r.p50, r.p95) == (10, 6.0, 10.0)


def test_line_diff_scans_greedily():
    assert analytics.line_changes(["a", "b", "c"], ["a", "x", "c"]) == [" a", "-b", "+x", " c"]
    assert analytics.line_changes(["a"], []) == ["-a"] and analytics.line_changes([], ["a"]) == ["+a"]
    assert analytics.line_changes(["a", "b"], ["b"]) == ["-a", " b"]


def test_character_diff_of_empty_texts(spark):
    d = analytics.character_diff(F.col("a"), F.col("b"))
    assert [one(spark, d[k], a="", b="abc") for k in ("added", "removed", "unchanged")] == [3, 0, 0]
    assert [one(spark, d[k], a="abcd", b="abxd") for k in ("added", "removed", "unchanged")] == [1, 1, 3]


def test_cleaning(spark):
    assert one(spark, text.remove_repetitions("t"), t="the the cat !!! sat Sat") == "the cat ! sat"
    assert one(spark, text.fix_capitalization("t"), t="one. two! three") == "One. Two! Three"
    assert one(spark, text.remove_incomplete_sentences("t"), t="Done. Also done! not") == "Done. Also done!"
    assert one(spark, text.remove_think_tags("t"), t=" <think>a\nb</think> x [THINK]y[/THINK]") == "x"
    assert one(spark, text.clean("t"), t="a  b\n\n\n\nc .") == "a b\n\nc."
    assert one(spark, text.json_object("t"), t='x {"a": [1]} y') == '{"a": [1]}' and one(spark, text.json_object("t"), t="{bad") is None


def test_null_texts_count_as_empty(spark):
    row = spark.range(1).select(F.lit(None).cast("string").alias("t"))
    for f in (text.bm25_tokens, text.query_tokens, text.metric_tokens, text.overlap_tokens, text.sentences, text.bullet_points, text.code_blocks, text.table_cells, text.citations):
        assert row.select(f("t").alias("x")).first().x == []
    assert row.select(text.detect_format("t").alias("x")).first().x == "text"


ACCENTED = "Esciónall í none, ñalways never. Été12% ok"


def test_word_bounds_are_those_of_sql(spark):
    """An accented letter is no word character in SQL's patterns, nor here."""
    assert one(spark, F.round(text.hallucination("t"), 6), t=ACCENTED) == 0.35
    assert one(spark, text.contradictory("t"), t="íall í none") is True and one(spark, text.contradictory("t"), t="ball none") is False
    assert one(spark, text.contradiction_density("t"), t="One. ébut two. Three") == 0.5
    assert one(spark, readers.html_counts("t")["images"], t="<imgé <img> <images>") == 2


def test_decomposition(spark):
    got = one(spark, expansion.subqueries("t"), t="red cars and blue bikes, or fast trains but slow boats, x, ok then")
    assert got == ["red cars", "blue bikes", "fast trains"] or got == ["red cars", "blue bikes", "slow boats"] or len(got) == 3


def test_knn_blocks_filters_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), i % 2) for i in range(60)] + [(60, [0.0] * 8, 0), (61, None, 0)]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    queries = vecs.where("vec_id < 10")
    a = {(r.query_id, r.rank): r.id for r in vectors.knn(vecs, queries, 3, block=3).collect()}
    b = {(r.query_id, r.rank): r.id for r in vectors.knn(vecs, queries, 3, block=1000).collect()}
    assert a == b and all(a[q, 1] == q for q in range(10))
    assert all(r.id % 2 for r in vectors.knn(vecs, queries, 3, where=F.col("label") == 1).collect())
    assert vectors.knn(vecs, vecs.where("false"), 3).count() == 0
    assert vectors.delete_vectors(vecs, queries).count() == 52


def test_knn_in_blocks_and_within_groups(spark):
    vecs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    queries = vecs.where("vec_id % 5 = 0")
    whole = sorted(map(tuple, vectors.knn(vecs, queries, 3).select("query_id", "id", "rank").collect()))
    assert whole == sorted(map(tuple, vectors.knn(vecs, queries, 3, block=4).select("query_id", "id", "rank").collect()))
    within = proximity.nearest_within(vecs, queries, "label", 3, part_rows=4, block=3)
    same = vecs.select("vec_id", "label")
    pairs = within.join(same, within.query_id == same.vec_id).select("query_id", "id", F.col("label").alias("own")).join(same, F.col("id") == same.vec_id)
    assert pairs.where("own = label").count() == within.count() == pairs.count() > queries.count()
    assert within.where("rank = 1 AND query_id = id").count() == queries.count()


def test_values_are_put_into_templates_as_they_are(spark):
    df = spark.createDataFrame([("see {context}", "{question}|\\1")], "q string, c string")
    assert df.select(prompts.fill("{{x}} {question}|{context}|{question}", question=F.col("q"), context=F.col("c"))).first()[0] == "{x} see {context}|{question}|\\1|see {context}"
    assert df.select(prompts.fill("none")).first()[0] == "none"


def test_every_chunk_finds_its_document(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "a brown fox jumps, and then"), (3, None), (0, "of the and")], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, "brown"), (2, "brown fox"), (3, "fox jumps, and"), (4, "x"), (5, "of the and"), (6, "no such text here"), (7, None), (8, "row"), (9, ""), (9, "quick brown fox")], "c long, chunk string")
    for block in (1, 500):
        found = {r.c: r.doc_id for r in services.containing(docs, chunks, "doc_id", "text", "c", "chunk", block).collect()}
        assert found == {1: 1, 2: 1, 3: 2, 4: 1, 5: 0, 8: 1, 9: 0}


def test_an_index_is_written_anew_for_a_table_rewritten_in_place(spark, tmp_path):
    from quillspark.plans import retrieval

    terms = []
    for k, words in enumerate(("alpha beta", "gamma delta")):
        spark.createDataFrame([(1, words)], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        part = next((tmp_path / "documents.parquet").glob("part-*"))
        for other in (tmp_path / "documents.parquet").glob(".*"):
            other.unlink()
        part.rename(tmp_path / "documents.parquet" / "part-0.parquet")
        os.utime(tmp_path / "documents.parquet" / "part-0.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        spark.catalog.refreshByPath(f"{tmp_path}/documents.parquet")
        terms.append({r.term for r in retrieval._index(spark, str(tmp_path)).terms.collect()})
    assert terms == [{"alpha", "beta"}, {"gamma", "delta"}]


def test_wrong_dimension_raises(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    with pytest.raises(Exception, match="expected 3 dimensions"):
        df.select(vector.check_dimension("embedding", 3)).collect()


def test_bm25_on_empty_corpora(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a query")], "item_id long, text string")
    assert keyword.bm25_search(keyword.build_index(docs), queries).collect() == []


def test_saved_index_gives_the_same_hits(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    queries = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    index = keyword.build_index(docs)
    keyword.save_index(index, str(tmp_path / "index"))
    stored = keyword.load_index(spark, str(tmp_path / "index"))
    hits = lambda i: {(r.item_id, r.doc_id, round(r.score, 9)) for r in keyword.bm25_search(i, queries, 5).collect()}
    assert hits(stored) == hits(index)
    cosines = lambda i: {(r.item_id, r.doc_id, round(r.score, 9)) for r in keyword.tfidf_scores(i, queries).collect()}
    assert cosines(stored) == cosines(index)


def test_search_scores_where_documents_are_read(spark, tmp_path):
    """The hits of all pairs, cut to k, for repeated and null ids and in blocks of queries; no postings are joined or shuffled for them."""
    rows = [(1, "red apples and green pears"), (1, "red red wine"), (2, "green tea"), (3, None), (None, "red tea"), (4, "tea tea tea pears"), (5, "green tea"), (6, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red tea tea"), (2, "green"), (3, "none of it"), (4, None), (5, "pears wine red")], "item_id long, text string")
    keyword.save_index(keyword.build_index(docs), str(tmp_path / "index"), usual=2)
    index = keyword.load_index(spark, str(tmp_path / "index"))
    rounded = lambda df: sorted((r.item_id, r.rank, r.doc_id, round(r.score, 9)) for r in df.collect())
    for search, scores in ((keyword.bm25_search, keyword.bm25_scores), (keyword.tfidf_search, keyword.tfidf_scores)):
        want = rounded(ranking.top_k(scores(keyword.build_index(docs), queries), "item_id", "doc_id", 2))
        assert len(want) == 6 and rounded(search(index, queries, 2)) == want and rounded(search(keyword.build_index(docs), queries, 2)) == want
        assert "Join" not in search(index, queries, 2)._jdf.queryExecution().executedPlan().toString()
    both = [(r.item_id, r.rank, r.doc_id, round(r.bm25, 9)) for r in keyword.search(index, queries, 2, block=2).collect()]
    assert sorted(both) == rounded(keyword.bm25_search(index, queries, 2))


def test_mmr_and_cross_encoder(spark):
    rows = [(1, 10, 3.0, 1, "a b c", "q"), (1, 11, 2.9, 2, "a b c", "q"), (1, 12, 1.0, 3, "x y z", "q")]
    c = spark.createDataFrame(rows, "q long, i long, score double, rank long, text string, query string")
    assert [r.i for r in rerank.mmr(c, "q", "i", k=2, trade=0.3).orderBy("rank").collect()] == [10, 12]
    best = rerank.cross_encoder(c, lambda q, t: t.str.len() * 0 + (t == "x y z").astype(float), "q", "i", 1).collect()
    assert [(r.i, round(r.score, 6)) for r in best] == [(12, round(1 / (1 + math.exp(-1)), 6))]
    assert {round(r.score, 6) for r in rerank.cross_encoder(c, lambda q, t: 1 / 0, "q", "i").collect()} == {0.5}


def test_prompts(spark):
    with pytest.raises(KeyError):
        prompts.fill(prompts.QA_TEMPLATE, context=F.lit("x"))
    df = spark.createDataFrame([(1, "same words"), (2, "same words"), (3, None)], "id long, text string")
    v = {r.id: r.embedding for r in prompts.embed(df, "id", "text", 16).collect()}
    assert v[1] == v[2] and sum(x * x for x in v[1]) == pytest.approx(1.0, abs=1e-5) and set(v[3]) == {0.0}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.md").write_text("# head")
    (tmp_path / "c.xyz").write_text("?")
    (tmp_path / "d.txt").write_text("")
    (tmp_path / "e.pdf").write_text("x")
    texts, errors = readers.read_files(spark, str(tmp_path))
    assert {(r.file_type, r.content) for r in texts.collect()} == {("txt", "hello"), ("md", "# head")}
    assert sorted(r.error_code for r in errors.collect()) == ["PARSER_NOT_INSTALLED", "UNSUPPORTED_TYPE"]
    listed = spark.createDataFrame([("x/d.txt", 0), ("x/e.txt", 1 << 40)], "path string, length long")
    assert [r.error_code for r in readers.validated(listed).orderBy("path").collect()] == ["EMPTY_FILE", "FILE_TOO_LARGE"]


def test_delimiters(spark):
    assert one(spark, readers.delimiter(F.col("t")), t="a;b;c d e f") == ";" and one(spark, readers.delimiter(F.col("t")), t="a b c d") == " "


def test_html_walk():
    page = "<html><nav><a href='/n'>n</a></nav><body><main><h2>Head &amp; more</h2><p>One<br>two</p><ol><li>x</li><li>y</li></ol><table><tr><th>a</th></tr><tr><td>1</td></tr></table><a href='http://d.org/p'>l</a></main><footer>f</footer></body>"
    content, tables, links, domains = readers.walk(page)
    assert content.split("\n\n")[:5] == ["## Head & more", "One", "two", "1. x", "2. y"]
    assert (tables, links, domains) == (1, 1, ["d.org"]) and "f" not in content.split("\n\n")
    assert readers.walk(None) == ("", 0, 0, [])


def test_qa_sources_and_exports(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"data": [{"paragraphs": [{"context": "c", "qas": [{"question": "q", "answers": [{"text": "a"}, {"text": "b"}]}]}]}]}')
    assert [tuple(r) for r in readers.squad(spark, str(tmp_path / "s.json")).select("query", "reference", "context").collect()] == [("q", "a", "c")]
    (tmp_path / "q.jsonl").write_text('{"question": "q1", "answer": "a1"}\n{"question": "", "answer": "a"}\n')
    (tmp_path / "q.csv").write_text("question,answer\nq2,a2\n")
    rows = readers.qa_pairs(spark, [str(tmp_path / "q.jsonl"), str(tmp_path / "q.csv")])
    assert {r.question for r in rows.collect()} == {"q1", "q2"}
    for kind in ("json", "csv", "txt"):
        readers.export(rows, str(tmp_path / kind), kind)
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    with pytest.raises(ValueError):
        readers.export(rows, str(tmp_path / "x"), "x")


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    readers.save_store(df, str(tmp_path / "v"), "embedding")
    assert readers.load_store(spark, str(tmp_path / "v"), "embedding", 2).count() == 1


def test_retry_and_batch_sizes():
    assert [analytics.retry_delay(n) for n in (0, 3, 10)] == [1.0, 8.0, 60.0]
    assert analytics.next_batch_size(20, 100.0, 6.0) == 16 and analytics.next_batch_size(20, 100.0, 1.0) == 26


def test_judged_by_label_equals_judged(spark):
    labelled = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (6, "a")], "id long, label string")
    ranked = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 1, 3), (3, 1, 1), (4, 5, 1), (6, 9, 1)], "q long, i long, rank long")
    own, other = labelled.select(F.col("id").alias("q"), "label"), labelled.select(F.col("id").alias("i"), "label")
    relevant = own.join(other, "label").where("q <> i").select("q", "i")
    rows = lambda df: {tuple(r) for r in df.select("q", "i", "rank", "hit", "n_relevant").collect()}
    assert rows(evaluation.judged_by_label(ranked, labelled, "q", "i", "id", "label")) == rows(evaluation.judged(ranked, relevant, "q", "i"))


def test_python_passes_hold_a_few_rows_at_a_time(spark, monkeypatch):
    """What a batch gives comes out in parts: the passes never hold the results of a whole one. Results are those of one row at a time."""
    import pyarrow as pa

    sizes = []

    class Frame:
        """A table whose batch is handed to the function of ``mapInArrow`` here."""

        def __init__(self, df):
            self.df, self.schema = df, df.schema

        def select(self, *cols):
            return Frame(self.df.select(*cols))

        def mapInArrow(self, run, schema):
            batch = self.df.toArrow().combine_chunks().to_batches()[0]
            out = list(run(iter([batch])))
            sizes.append([b.num_rows for b in out])
            return pa.Table.from_batches(out)

    pages = spark.range(600).select("id", F.format_string("<h1>t%d</h1><a href='http://x%d.org'>l</a>", "id", "id").alias("html"))
    got = readers.html_text(Frame(pages), "id", "html")
    assert got["text"].to_pylist() == [readers.walk(f"<h1>t{n}</h1><a href='http://x{n}.org'>l</a>")[0] for n in range(600)] and max(sizes[-1]) <= 128
    pairs = spark.range(600).select("id", F.lit("the cat sat on the mat").alias("c"), F.when(F.col("id") > 0, F.lit("the cat sat")).alias("r"))
    got = evaluation.generation_scores(Frame(pairs), "id", "c", "r").to_pylist()
    words = ["the cat sat on the mat".split(), "the cat sat".split()]
    assert got[5] == {"id": 5, "bleu": evaluation.bleu(*words), "rouge_l": evaluation.rouge_l(*words), "meteor": evaluation.meteor(*words)} and got[0]["bleu"] == 0.0 and max(sizes[-1]) <= 256
    code = spark.range(600).select("id", F.lit("def f():\n    pass\n").alias("t"))
    assert len(chunking.chunk(Frame(code), "code_file", "id", "t")) == 600 and max(sizes[-1]) <= 256


def test_knn_in_parts_keeps_ties_by_id(spark):
    rows = [(n, [1.0, float(n % 5)]) for n in range(97)]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    hits = lambda part: sorted(map(tuple, vectors.knn(store, store.where("vec_id < 6"), 7, part=part).collect()))
    assert hits(3) == hits(1024) and [r[1] for r in hits(3) if r[0] == 0] == [0, 5, 10, 15, 20, 25, 30]


def test_probed_queries_come_out_in_parts_of_bounded_size(spark, tmp_path):
    """Each query comes out once for each cell that it probes, so a batch of many queries is cut."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(rng.normal(size=(600, 4)))], "vec_id long, embedding array<float>")
    index = proximity.CellIndex.build(rows, str(tmp_path / "cells"), coarse="flat", cell_rows=2)
    held, taken = [], proximity.CellIndex.nearest
    proximity.CellIndex.nearest = staticmethod(lambda quantizer, x, k, *rest: held.append(len(x) * k) or taken(quantizer, x, k, *rest))
    try:
        asked = proximity.query_blocks(rows, "vec_id", "embedding", 1000)[0].select("block", "query_id", "q").toArrow().combine_chunks().to_batches()
        found = sum(b.num_rows for b in index.probes(200, 64)(iter(asked)))
    finally:
        proximity.CellIndex.nearest = staticmethod(taken)
    assert found == 600 * 200 and max(held) <= 16_384


def test_claims_are_those_of_pythons_patterns():
    """Letters and blanks that Python matches when case is ignored count, as do line breaks, and the first pattern and the earliest place win."""
    rng = random.Random(4)
    parts = ["The", "the", "bathe", "foo", "Bar", "a", "été", "7", "3.5", "is", "iſ", "İs", "ıs", "was", "were", "have", "does", "did", "not", "founded", "eſtablıshed", "Kelvin", ".", "!", ",", "\n", "\t", "\x1c", "\x85", " ", "　", "  "]
    sentences = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 25))) for _ in range(20_000)]
    patterns = [re.compile(p, re.I) for p in evaluation.CLAIMS]
    want = [next(({"whole": m[0], "subject": m["subject"]} for p in patterns if (m := p.search(s))), None) for s in sentences]
    got = [m and {k: m[k] for k in ("whole", "subject")} for m in evaluation.first_claims(sentences)]
    assert got == want and sum(m is not None for m in want) > 2000


def test_claims_of_long_sentences_take_linear_time(spark):
    """The first of these took over a minute and the third over three when every word was tried against every other."""
    long = ["Anou " * 6000 + "x.y", "The a was " * 3000 + "x.y", "x.y " + "the was " * 4000, "no. " + "." * 30_000 + "x"]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(long)] + [(None, "Short one. Yes it is so."), (9, None)], "doc_id long, text string")
    started = time.time()
    rows = {r.doc_id: (r.sentence_index, r.claim, r.subject, r.kind) for r in evaluation.claims(docs, "doc_id", "text").collect()}
    assert time.time() - started < 60
    assert rows[0] == (0, long[0], None, "statement") and rows[2] == (0, long[2].strip(), None, "statement")
    assert rows[1] == (0, long[1][:-1], "a", "factual") and rows[None] == (1, "Yes it is so.", "Yes it", "factual")
    assert set(rows) == {0, 1, 2, None}

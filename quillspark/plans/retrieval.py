"""Queries on keyword search, vector search, normalisation, fusion, retrievers and rerankers.

Every benchmark item is a query over all documents; vector queries are the vectors whose id is divisible by 20.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text, vector
from quillspark.operators import keyword, proximity, ranking, rerank, retrievers, vectors
from quillspark.plans.registry import register
from quillspark.session import shared_path, table

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def sql_tokens(column: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({column}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN ({STOP}))"


INDEX = f"""
tok AS (SELECT doc_id, {sql_tokens("text")} AS ts FROM documents),
len AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS dl FROM tok),
tot AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl, CAST(sum(dl) AS BIGINT) AS n_terms FROM len),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS r FROM dfs, tot),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({sql_tokens("text")}) AS term FROM benchmark) GROUP BY ALL)
"""
SCORED = (
    INDEX
    + """,
bm AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN len USING (doc_id), tot GROUP BY ALL),
w AS (SELECT term, ln((1 + n_docs) / (1 + df)) + 1 AS w FROM dfs, tot),
dv AS (SELECT doc_id, term, tf * w AS dw FROM post JOIN w USING (term)),
qv AS (SELECT item_id, term, qtf * w AS qw FROM qt JOIN w USING (term)),
tfidf AS (SELECT item_id, doc_id, any_value(dot) / (any_value(dn) * any_value(qn)) AS score FROM (
    SELECT item_id, doc_id, sum(dw * qw) AS dot FROM dv JOIN qv USING (term) GROUP BY ALL)
    JOIN (SELECT doc_id, sqrt(sum(dw * dw)) AS dn FROM dv GROUP BY doc_id) USING (doc_id)
    JOIN (SELECT item_id, sqrt(sum(qw * qw)) AS qn FROM qv GROUP BY item_id) USING (item_id) GROUP BY ALL),
b20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm) WHERE rank <= 20),
t20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM tfidf) WHERE rank <= 20)
"""
)
BOTH = (
    SCORED
    + """,
pair AS (SELECT item_id, doc_id, coalesce(b20.score, 0.0) AS s0, coalesce(t20.score, 0.0) AS s1 FROM b20 FULL JOIN t20 USING (item_id, doc_id)),
nm AS (SELECT item_id, doc_id,
    CASE WHEN max(s0) OVER q = min(s0) OVER q THEN 1.0 ELSE (s0 - min(s0) OVER q) / (max(s0) OVER q - min(s0) OVER q) END AS n0,
    CASE WHEN max(s1) OVER q = min(s1) OVER q THEN 1.0 ELSE (s1 - min(s1) OVER q) / (max(s1) OVER q - min(s1) OVER q) END AS n1
    FROM pair WINDOW q AS (PARTITION BY item_id)),
half AS (SELECT item_id, doc_id, n0 * 0.7 AS h0, n1 * 0.3 AS h1 FROM nm)
"""
)


_STORED: dict[tuple, str] = {}


def _version(df: DataFrame) -> tuple:
    """Count and digest of the names, lengths and times of a table's files: rewritten in place, it has another version."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first())


def _stored(spark: SparkSession, sf_dir: str, name: str, kind: str, write: Callable[[DataFrame, str], object]) -> str:
    """Where an index of a table is stored; it is written at its first use in a session, and anew when the table has changed."""
    df = table(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, sf_dir, kind, _version(df))
    if key not in _STORED:
        path = shared_path(spark, kind)
        write(df, path)
        _STORED[key] = path
    return _STORED[key]


def _index(spark: SparkSession, sf_dir: str) -> keyword.Index:
    return keyword.load_index(spark, _stored(spark, sf_dir, "documents", "keyword-index", lambda docs, path: keyword.save_index(keyword.build_index(docs), path)))


def _bm25(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return keyword.bm25_search(_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), k)


def _tfidf(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return keyword.tfidf_search(_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), k)


def _both(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """(item, doc, bm25, tfidf, rank): the best by BM25 with both scores, which are taken where the documents are read."""
    return keyword.search(_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), k)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


@register("bm25_topk", f"WITH {SCORED} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM b20 WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_bm25(spark, sf_dir, 5), "score")


@register("bm25_postings", f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_index(spark, sf_dir).terms, "idf")


@register("bm25_incremental", f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = keyword.build_index(docs.where("lang = 'en'"))
    return _rounded(keyword.add_documents(part, docs.where("lang <> 'en'")).terms, "idf")


@register("bm25_index_stats", f"WITH {INDEX} SELECT n_docs, round(avgdl, 6) AS avgdl, n_terms, (SELECT count(*) FROM dfs) AS n_vocabulary FROM tot")
def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return _rounded(index.totals.join(index.terms.agg(F.count("*").alias("n_vocabulary"))), "avgdl")


@register("tfidf_topk", f"WITH {SCORED} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM t20 WHERE rank <= 5")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_tfidf(spark, sf_dir, 5), "score")


# --- normalisation

_NORMS = {
    "min_max": "CASE WHEN max(score) OVER q = min(score) OVER q THEN 1.0 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END",
    "z_score": "CASE WHEN count(*) OVER q < 2 OR stddev_pop(score) OVER q = 0 THEN 0.5 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END",
    "sigmoid": "1.0 / (1.0 + exp(-score))",
    "rank": "1.0 - (rank - 1) / (count(*) OVER q)",
    "softmax": "exp(score - max(score) OVER q) / (SELECT sum(exp(x.score - b20.mx)) FROM (SELECT item_id, score FROM b20) x WHERE x.item_id = b20.item_id)",
}
for _name, _expr in _NORMS.items():
    _from = "b20" if _name != "softmax" else "(SELECT *, max(score) OVER (PARTITION BY item_id) AS mx FROM b20) AS b20"

    def _norm(spark: SparkSession, sf_dir: str, method: str = _name) -> DataFrame:
        return _rounded(ranking.normalize_scores(_bm25(spark, sf_dir), ["score"], "item_id", "doc_id", method).select("item_id", "doc_id", F.col("score").alias("normalized")), "normalized")

    if _name == "softmax":
        _sql = f"WITH {SCORED}, e AS (SELECT item_id, doc_id, exp(score - max(score) OVER (PARTITION BY item_id)) AS e FROM b20) SELECT item_id, doc_id, round(e / sum(e) OVER (PARTITION BY item_id), 6) AS normalized FROM e"
    else:
        _sql = f"WITH {SCORED} SELECT item_id, doc_id, round({_expr}, 6) AS normalized FROM b20 WINDOW q AS (PARTITION BY item_id)"
    register(f"norm_{_name}", _sql)(_norm)

# --- fusion

_FUSIONS = {
    "rrf": "0.7 / (60 + row_number() OVER (PARTITION BY item_id ORDER BY round(h0, 6) DESC, doc_id)) + 0.3 / (60 + row_number() OVER (PARTITION BY item_id ORDER BY round(h1, 6) DESC, doc_id))",
    "weighted": "h0 * 0.7 + h1 * 0.3",
    "average": "h0 * 0.7 + h1 * 0.3",
    "max": "greatest(0.0, h0, h1)",
    "min": "least(1.0, h0, h1)",
    "concave": "sqrt(h0 * 0.7 + h1 * 0.3)",
}
for _name, _expr in _FUSIONS.items():

    def _fuse(spark: SparkSession, sf_dir: str, strategy: str = _name) -> DataFrame:
        return _rounded(ranking.fuse([_bm25(spark, sf_dir), _tfidf(spark, sf_dir)], "item_id", "doc_id", strategy, [0.7, 0.3]), "score")

    register(f"fuse_{_name}", f"WITH {BOTH} SELECT item_id, doc_id, round({_expr}, 6) AS score FROM half")(_fuse)


@register("hybrid_topk", f"""WITH {BOTH}, f AS (SELECT item_id, doc_id, {_FUSIONS["weighted"]} AS score FROM half),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM f)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r JOIN documents USING (doc_id) WHERE rank <= 5""")  # fmt: skip
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = ranking.fuse([_bm25(spark, sf_dir), _tfidf(spark, sf_dir)], "item_id", "doc_id", "weighted", [0.7, 0.3])
    return _rounded(ranking.top_k(fused, "item_id", "doc_id", 5), "score")


# --- vectors

_KNN = """
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
"""


def _knn_sql(score: str, k: int = 5, where: str = "TRUE", outer: str = "TRUE") -> str:
    return f"WITH {_KNN}, s AS (SELECT query_id, id, label, {score} AS score FROM q, v WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= {k} AND {outer}"


COSINE = "list_cosine_similarity(q, v)"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")


def _knn(spark: SparkSession, sf_dir: str, k: int = 5, **options) -> DataFrame:
    return vectors.knn(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), k, **options)


@register("knn_cosine", _knn_sql(COSINE))
def knn_cosine(spark, sf_dir):
    return _rounded(_knn(spark, sf_dir), "score")


@register("knn_l2", _knn_sql("1.0 / (1.0 + list_distance(q, v) * list_distance(q, v))"))
def knn_l2(spark, sf_dir):
    return _rounded(_knn(spark, sf_dir, metric="l2"), "score")


@register("knn_dot", _knn_sql("list_inner_product(q, v)"))
def knn_dot(spark, sf_dir):
    return _rounded(_knn(spark, sf_dir, metric="dot"), "score")


@register("knn_threshold", _knn_sql(COSINE, 10, outer="score >= 0.5"))
def knn_threshold(spark, sf_dir):
    return _rounded(_knn(spark, sf_dir, 10, threshold=0.5), "score")


@register("knn_prefilter", _knn_sql(COSINE, where="label = 1"))
def knn_prefilter(spark, sf_dir):
    return _rounded(_knn(spark, sf_dir, where=F.col("label") == 1), "score")


@register("knn_postfilter", _knn_sql(COSINE, outer="label = 1"))
def knn_postfilter(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return _rounded(_knn(spark, sf_dir).join(labels, "id").where("label = 1").select("query_id", "id", "score", "rank"), "score")


def _hnsw(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    path = _stored(spark, sf_dir, "embeddings", "graph-index", lambda vecs, path: proximity.save_graph(proximity.build_graph(vecs), path))
    return proximity.search_graph(proximity.load_graph(spark, path), _queries(spark, sf_dir), k)


def _ivf(spark: SparkSession, sf_dir: str, coarse: str, k: int = 10) -> DataFrame:
    """Two fifths of the cells are read. Beyond 512 of them cells grow instead, so a query meets a bounded number, whatever the size of the table."""
    path = _stored(spark, sf_dir, "embeddings", f"cells-{coarse}", lambda vecs, path: proximity.CellIndex.build(vecs, path, coarse=coarse, cell_rows=50, max_cells=512))
    index = proximity.CellIndex(spark, path)
    return index.search(_queries(spark, sf_dir), k, probe=max(8, -(-2 * len(index.quantizer.ids) // 5)), ef=256)


@register("knn_hnsw")
def knn_hnsw(spark, sf_dir):
    return _rounded(_hnsw(spark, sf_dir), "score")


@register("knn_ivf")
def knn_ivf(spark, sf_dir):
    return _rounded(_ivf(spark, sf_dir, "flat"), "score")


@register("knn_ivf_hnsw")
def knn_ivf_hnsw(spark, sf_dir):
    return _rounded(_ivf(spark, sf_dir, "graph"), "score")


@register("ann_recall", f"""WITH {_KNN}, n AS (SELECT count(*) AS n FROM v), a AS (SELECT count(*) * least(10, (SELECT n FROM n)) AS n_exact FROM q)
SELECT unnest(['hnsw', 'ivf', 'ivf_hnsw']) AS method, CAST(n_exact AS BIGINT) AS n_exact, TRUE AS enough FROM a""")
def ann_recall(spark, sf_dir):
    """Whether each index finds at least 0.9 of what exact search finds."""
    exact = _knn(spark, sf_dir, 10).select("query_id", "id")
    found = {"hnsw": _hnsw(spark, sf_dir), "ivf": _ivf(spark, sf_dir, "flat"), "ivf_hnsw": _ivf(spark, sf_dir, "graph")}
    both = [exact.withColumn("method", F.lit(name)).join(df.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left") for name, df in found.items()]
    rows = reduce(DataFrame.union, both)
    return rows.groupBy("method").agg(F.count("*").alias("n_exact"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@register("vec_normalise", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm, CAST(1.0 AS DOUBLE) AS unit_norm FROM embeddings")
def vec_normalise(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm("embedding"), 6).alias("norm"), F.round(vector.norm(vector.normalize("embedding")), 6).alias("unit_norm"))


@register("vec_dim_check", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings")
def vec_dim_check(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(vector.check_dimension("embedding", 64)).cast("long").alias("dim"))


@register("store_stats", "SELECT count(*) AS n_vectors, CAST(max(len(embedding)) AS BIGINT) AS dimension, CAST(sum(len(embedding) * 4) AS BIGINT) AS n_bytes, CAST(CASE WHEN count(*) < 10000 THEN 64 WHEN count(*) < 100000 THEN 128 ELSE 256 END AS BIGINT) AS width, round(sum(len(embedding) * 4) / 1048576.0, 6) AS mb FROM embeddings")
def store_stats(spark, sf_dir):
    s = vectors.store_stats(table(spark, sf_dir, "embeddings"))
    return s.select("*", vectors.search_parameters(F.col("n_vectors")).alias("width"), F.round(F.col("n_bytes") / 1048576.0, 6).alias("mb"))


@register("delete_anti", "SELECT vec_id, label FROM embeddings WHERE vec_id % 20 <> 0")
def delete_anti(spark, sf_dir):
    return vectors.delete_vectors(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir)).select("vec_id", "label")


# --- retrievers


@register("retriever_hybrid", f"""WITH {BOTH}, f AS (SELECT item_id, doc_id, {_FUSIONS["weighted"]} AS score FROM half),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM f) SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def retriever_hybrid(spark, sf_dir):
    """The factory's hybrid retriever over two keyword retrievers; its weights are brought to a sum of 1."""
    parts = [retrievers.create_retriever("keyword", index=_index(spark, sf_dir), method=m) for m in ("bm25", "tfidf")]
    return _rounded(retrievers.create_retriever("hybrid", parts=parts, weights=[1.4, 0.6], k=5).retrieve(table(spark, sf_dir, "benchmark")), "score")


@register("rerank_splice", f"""WITH {SCORED}, t AS (SELECT item_id, doc_id, score AS s FROM tfidf), j AS (SELECT b20.item_id, doc_id, b20.score, b20.rank, CASE WHEN b20.rank <= 10 THEN s END AS s FROM b20 LEFT JOIN t USING (item_id, doc_id))
SELECT item_id, doc_id, round(coalesce(s, score), 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY s IS NULL, round(s, 6) DESC, rank, doc_id) AS rank FROM j""")
def rerank_splice(spark, sf_dir):
    """The ten best of twenty are scored anew and put back in front of the others."""
    found = _both(spark, sf_dir)
    ranked = found.select("item_id", "doc_id", F.col("bm25").alias("score"), "rank")
    again = found.where("rank <= 10").select("item_id", "doc_id", F.col("tfidf").alias("score"))
    return _rounded(rerank.spliced(ranked, again, "item_id", "doc_id"), "score")


@register("retrieve_multistage", f"WITH {SCORED}, c AS (SELECT item_id, doc_id, tfidf.score FROM b20 JOIN tfidf USING (item_id, doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM c) SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def retrieve_multistage(spark, sf_dir):
    second = _both(spark, sf_dir).select("item_id", "doc_id", F.col("tfidf").alias("score"))
    return _rounded(ranking.top_k(second, "item_id", "doc_id", 5), "score")


@register("retrieve_ensemble", f"WITH {SCORED}, u AS (SELECT item_id, doc_id, 0.7 * score AS s FROM b20 WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, 0.3 * score FROM t20 WHERE rank <= 10), g AS (SELECT item_id, doc_id, sum(s) AS score FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM g) SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def retrieve_ensemble(spark, sf_dir):
    merged = rerank.ensemble([_bm25(spark, sf_dir, 10), _tfidf(spark, sf_dir, 10)], [0.7, 0.3], "item_id", "doc_id", "weighted")
    return _rounded(ranking.top_k(merged, "item_id", "doc_id", 5), "score")


@register("retrieve_context_query", """WITH t AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN substr(text, 1, 200) ELSE text END AS said, text FROM conversations),
h AS (SELECT *, string_agg(role || ': ' || said, chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS history FROM t)
SELECT conv_id, turn, CASE WHEN history IS NULL THEN text ELSE history || chr(10) || 'Current: ' || text END AS query FROM h WHERE role = 'user'""")
def retrieve_context_query(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    said = F.when(F.col("role") == "assistant", F.substring("text", 1, 200)).otherwise(F.col("text"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-5, -1)
    history = F.array_join(F.transform(F.collect_list(F.struct(F.lit(0), F.concat_ws(": ", "role", said).alias("line"))).over(w), lambda x: x["line"]), "\n")
    return t.withColumn("history", history).where("role = 'user'").select("conv_id", "turn", F.when(F.col("history") == "", F.col("text")).otherwise(F.concat(F.col("history"), F.lit("\nCurrent: "), F.col("text"))).alias("query"))


# --- rerankers


@register("rerank_rrf", f"WITH {SCORED}, u AS (SELECT item_id, doc_id, 1.0 / (60 + rank) AS s FROM b20 UNION ALL SELECT item_id, doc_id, 1.0 / (60 + rank) FROM t20) SELECT item_id, doc_id, round(sum(s), 6) AS score FROM u GROUP BY ALL")
def rerank_rrf(spark, sf_dir):
    return _rounded(rerank.reciprocal_rank([_bm25(spark, sf_dir), _tfidf(spark, sf_dir)], "item_id", "doc_id"), "score")


for _method, _agg in (("weighted", "sum(s)"), ("max", "max(s)")):

    def _ensemble(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        return _rounded(rerank.ensemble([_bm25(spark, sf_dir), _tfidf(spark, sf_dir)], [0.5, 0.5], "item_id", "doc_id", method), "score")

    _w = "0.5 * " if _method == "weighted" else ""
    register(f"rerank_ensemble_{_method}", f"WITH {SCORED}, u AS (SELECT item_id, doc_id, {_w}score AS s FROM b20 UNION ALL SELECT item_id, doc_id, {_w}score FROM t20) SELECT item_id, doc_id, round({_agg}, 6) AS score FROM u GROUP BY ALL")(_ensemble)

_WORDS = r"list_distinct(list_filter(string_split_regex(lower(coalesce({}, '')), '\s+'), lambda x: x <> ''))"


def _candidates(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    return _bm25(spark, sf_dir, k).join(docs, "doc_id").join(queries, "item_id")


@register("rerank_feature", f"""WITH {SCORED}, c AS (SELECT b20.item_id, b20.doc_id, score, rank, d.text AS t, {_WORDS.format("d.text")} AS tw, {_WORDS.format("q.text")} AS qw FROM b20 JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = b20.item_id)
SELECT item_id, doc_id, round(0.4 * score + 0.1 * least(1.0, length(t) / 1000.0) + 0.2 * len(list_intersect(qw, tw)) / greatest(len(qw), 1) + 0.1 / (1 + 0.1 * (rank - 1))
  + 0.2 * (CASE WHEN len(qw) = 0 THEN 0 ELSE least(1.0, (contains(lower(t), 'important')::INT + contains(lower(t), 'key')::INT + contains(lower(t), 'critical')::INT + contains(lower(t), 'main')::INT + contains(lower(t), 'significant')::INT) / 3.0) END), 6) AS score FROM c""")
def rerank_feature(spark, sf_dir):
    return _rounded(rerank.by_features(_candidates(spark, sf_dir)).select("item_id", "doc_id", F.col("rerank_score").alias("score")), "score")


@register("sim_jaccard", f"""WITH {SCORED}, c AS (SELECT item_id, doc_id, {_WORDS.format("text")} AS w FROM b20 JOIN documents USING (doc_id) WHERE rank <= 5)
SELECT a.item_id, a.doc_id AS doc_a, b.doc_id AS doc_b, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 6) AS similarity FROM c a JOIN c b ON a.item_id = b.item_id AND a.doc_id < b.doc_id""")
def sim_jaccard(spark, sf_dir):
    return _rounded(rerank.jaccard_pairs(_candidates(spark, sf_dir, 5), "item_id", "doc_id"), "similarity")


@register("mmr_rerank")
def mmr_rerank(spark, sf_dir):
    return _rounded(rerank.mmr(_candidates(spark, sf_dir), "item_id", "doc_id", k=5), "score")

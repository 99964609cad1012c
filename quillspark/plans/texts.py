"""Queries on chunking, query expansion, evaluation, faithfulness, response processing and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import chunking, evaluation, expansion, keyword, proximity, responses, vectors
from quillspark.plans.registry import register
from quillspark.plans.retrieval import SCORED, STOP, _bm25, _both, _index, _rounded
from quillspark.session import table

WS = r"'\s+'"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def sql_words(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), {WS}), lambda x: x <> '')"


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def sql_query_tokens(c: str, stop: bool = False) -> str:
    t = rf"list_filter(string_split_regex(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"
    return f"list_filter({t}, lambda x: x NOT IN ({STOP}))" if stop else t


def sql_metric_tokens(c: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower(coalesce({c}, '')), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda x: x <> '')"


# --- chunking

_FIXED = """c AS (SELECT doc_id, text AS t, length(text) AS n, unnest(range(0, greatest(0, length(text) - 151) + 1, 650)) AS s FROM documents WHERE regexp_matches(text, '\\S'))"""
_FIXED_ROWS = f"SELECT doc_id, CAST(s // 650 AS BIGINT) AS chunk_index, {sql_strip('substr(t, CAST(s + 1 AS BIGINT), 800)')} AS text, CAST(s AS BIGINT) AS start_char, CAST(least(n, s + 800) AS BIGINT) AS end_char, CAST(least(n, s + 800) - s AS BIGINT) AS chunk_size FROM c"


@register("chunk_fixed", f"WITH {_FIXED} {_FIXED_ROWS}")
def chunk_fixed(spark, sf_dir):
    return chunking.chunk(_docs(spark, sf_dir), "fixed").drop("header")


@register("chunk_sliding", f"""WITH w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 21) + 1, 80)) AS s FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(s // 80 AS BIGINT) AS chunk_index, array_to_string(w[s + 1:s + 100], ' ') AS text, CAST(s AS BIGINT) AS start_token, CAST(least(len(w), s + 100) AS BIGINT) AS end_token FROM c""")
def chunk_sliding(spark, sf_dir):
    c = chunking.chunk(_docs(spark, sf_dir), "sliding", size=100, overlap=20)
    return c.select("doc_id", "chunk_index", "text", F.col("start_char").alias("start_token"), F.col("end_char").alias("end_token"))


_SENT = rf"list_filter(list_transform(string_split_regex(coalesce({{}}, ''), '[.!?]+\s+'), lambda x: {sql_strip('x')}), lambda x: x <> '')"


@register("chunk_sentence", f"""WITH s AS (SELECT doc_id, {_SENT.format('text')} AS p FROM documents), c AS (SELECT doc_id, p, unnest(range(0, len(p), 5)) AS b FROM s WHERE len(p) > 0)
SELECT doc_id, CAST(b // 5 AS BIGINT) AS chunk_index, array_to_string(p[b + 1:b + 5], ' ') AS text FROM c""")
def chunk_sentence(spark, sf_dir):
    return chunking.chunk(_docs(spark, sf_dir), "sentence", size=5).select("doc_id", "chunk_index", "text")


@register("chunk_paragraph", rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS chunk_index, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM s)""")
def chunk_paragraph(spark, sf_dir):
    spaced = _docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunking.chunk(spaced, "paragraph", size=1).select("doc_id", "chunk_index", "text")


@register("chunk_stats", f"WITH {_FIXED}, r AS ({_FIXED_ROWS}) SELECT count(*) AS total_chunks, round(avg(length(text)), 6) AS avg_size, CAST(min(length(text)) AS BIGINT) AS min_size, CAST(max(length(text)) AS BIGINT) AS max_size, CAST(sum(length(text)) AS BIGINT) AS total_chars, round(stddev_pop(length(text)), 6) AS std_size FROM r")
def chunk_stats(spark, sf_dir):
    return _rounded(chunking.stats(chunk_fixed(spark, sf_dir)), "avg_size", "std_size")


@register("chunk_overlap_check", f"""WITH {_FIXED}, r AS ({_FIXED_ROWS}), l AS (SELECT doc_id, chunk_index, text, lead(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS nxt FROM r)
SELECT doc_id, chunk_index, contains(substr(nxt, 1, 300), CASE WHEN length(text) <= 75 THEN text ELSE substr(text, length(text) - 74) END) AS overlaps FROM l WHERE nxt IS NOT NULL AND chunk_index < 5""")
def chunk_overlap_check(spark, sf_dir):
    return chunking.overlaps(chunk_fixed(spark, sf_dir), "doc_id", 150)


@register("chunk_fence_parity", f"WITH {_FIXED}, r AS ({_FIXED_ROWS}) SELECT doc_id, chunk_index, ((length(text) - length(replace(text, '```', ''))) // 3) % 2 = 1 AS odd_fences FROM r")
def chunk_fence_parity(spark, sf_dir):
    return chunk_fixed(spark, sf_dir).select("doc_id", "chunk_index", chunking.odd_fences(None).alias("odd_fences"))


for _strategy in ("recursive", "code", "markdown", "adaptive", "code_file"):

    def _chunks(spark: SparkSession, sf_dir: str, strategy: str = _strategy) -> DataFrame:
        return chunking.chunk(_docs(spark, sf_dir), strategy)

    register(f"chunk_{_strategy}")(_chunks)

# --- embedding stage


@register("token_estimates", "SELECT doc_id, CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS tokens, round(length(coalesce(text, '')) // 4 / 1000.0 * 0.00002, 9) AS cost, md5(substr(coalesce(text, ''), 1, 32764) || ':text-embedding-3-small:1536') AS cache_key FROM documents")
def token_estimates(spark, sf_dir):
    from quillspark.operators import prompts

    t = F.coalesce(F.col("text"), F.lit(""))
    n = prompts.token_estimate(t)
    return _docs(spark, sf_dir).select("doc_id", n.alias("tokens"), F.round(n / 1000.0 * 0.00002, 9).alias("cost"), prompts.embedding_key(prompts.clip_tokens(t, 8191), "text-embedding-3-small", 1536).alias("cache_key"))


@register("embed_hashing")
def embed_hashing(spark, sf_dir):
    from quillspark.operators import prompts

    return prompts.embed(_docs(spark, sf_dir), "doc_id", "text", dim=64)


# --- expansion


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


@register("expand_tokens", f"SELECT item_id, array_to_string({sql_query_tokens('text', True)}, ' ') AS tokens FROM benchmark")
def expand_tokens(spark, sf_dir):
    return _bench(spark, sf_dir).select("item_id", F.array_join(text.query_tokens("text", True), " ").alias("tokens"))


_SYN = "(VALUES ('the', 'this', 1), ('the', 'that', 2), ('of', 'from', 1), ('and', 'plus', 1), ('and', 'also', 2), ('and', 'with', 3), ('is', 'be', 1), ('to', 'toward', 1)) AS d(term, synonym, place)"
_SYN_ROWS = [("the", "this", 1), ("the", "that", 2), ("of", "from", 1), ("and", "plus", 1), ("and", "also", 2), ("and", "with", 3), ("is", "be", 1), ("to", "toward", 1)]


@register("expand_synonym", f"""WITH t AS (SELECT item_id, ts, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM (SELECT item_id, {sql_query_tokens('text')} AS ts FROM benchmark)),
f AS (SELECT item_id, pos, synonym, place, row_number() OVER (PARTITION BY item_id, synonym ORDER BY pos, place) AS rn FROM t JOIN {_SYN} ON term = token WHERE NOT list_contains(ts, synonym)),
a AS (SELECT *, row_number() OVER (PARTITION BY item_id, pos ORDER BY place, synonym) AS k FROM f WHERE rn = 1),
u AS (SELECT item_id, pos, 0 AS place, token AS term FROM t UNION ALL SELECT item_id, pos, k, synonym FROM a WHERE k <= 2)
SELECT item_id, string_agg(term, ' ' ORDER BY pos, place) AS expanded, round(least(1.0, 2.0 * sum((place > 0)::INT) / (sum((place = 0)::INT) + 1)), 6) AS confidence FROM u GROUP BY item_id""")
def expand_synonym(spark, sf_dir):
    dictionary = spark.createDataFrame(_SYN_ROWS, "term string, synonym string, place long")
    return _rounded(expansion.synonyms(_bench(spark, sf_dir), dictionary, "item_id", "text"), "confidence")


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _bm25(spark, sf_dir, 1).join(_docs(spark, sf_dir).select("doc_id", F.col("text").alias("context")), "doc_id")
    return best.join(_bench(spark, sf_dir).select("item_id", F.col("text").alias("query")), "item_id").select("item_id", "query", "context")


@register("expand_context", f"""WITH {SCORED}, p AS (SELECT b20.item_id, {sql_query_tokens('q.text', True)} AS own, {sql_query_tokens('d.text', True)} AS ctx FROM b20 JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = b20.item_id WHERE rank = 1),
t AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, own, unnest(ctx) AS term FROM p) WHERE length(term) > 2 AND NOT list_contains(own, term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, term) AS place FROM t) SELECT item_id, term, n, place FROM r WHERE place <= 10""")
def expand_context(spark, sf_dir):
    return expansion.context_terms(_context(spark, sf_dir), "item_id", "query", "context")


_TAKE = "list_filter(list_transform({}, lambda x: {}), lambda x: true)"


def _decompose_sql() -> str:
    parts = "[coalesce(text, '')]"
    for mark in (" and ", " or ", " but ", ", "):
        strip = sql_strip("y")
        parts = f"flatten(list_transform({parts}, lambda p: CASE WHEN contains(p, '{mark}') THEN list_transform(string_split(p, '{mark}'), lambda y: {strip}) ELSE [p] END))"
    many = sql_words("p")
    return f"WITH s AS (SELECT item_id, {parts} AS ps FROM benchmark), o AS (SELECT item_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM s), k AS (SELECT item_id, p, min(i) AS i FROM o WHERE len({many}) > 1 GROUP BY item_id, p), r AS (SELECT item_id, p, row_number() OVER (PARTITION BY item_id ORDER BY i) AS place FROM k) SELECT item_id, place, p AS term, round(1.0::DOUBLE - 0.1::DOUBLE * (place - 1), 6) AS weight FROM r WHERE place <= 3"


@register("expand_decompose", _decompose_sql())
def expand_decompose(spark, sf_dir):
    return _rounded(expansion.decomposed(_bench(spark, sf_dir), "item_id", "text"), "weight")


_FAQ = f"""q AS (SELECT item_id, list_distinct({sql_query_tokens('text', True)}) AS qs FROM benchmark),
f AS (SELECT conv_id * 100 + turn AS faq, list_distinct({sql_query_tokens('text', True)}) AS fs FROM conversations WHERE role = 'user'),
h AS (SELECT item_id, faq, any_value(nq) AS nq, any_value(nf) AS nf, count(*) AS n FROM (SELECT item_id, len(qs) AS nq, unnest(qs) AS t FROM q) JOIN (SELECT faq, len(fs) AS nf, unnest(fs) AS t FROM f) USING (t) GROUP BY ALL),
o AS (SELECT item_id, faq, n / greatest(nq, nf) AS overlap FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(overlap, 6) DESC, faq) AS place FROM o WHERE overlap > 0.1)"""


@register("expand_faq", f"WITH {_FAQ} SELECT item_id, faq, round(overlap, 6) AS overlap, place FROM r WHERE place <= 3")
def expand_faq(spark, sf_dir):
    faq = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("faq_id"), F.col("text").alias("faq_text"))
    return _rounded(expansion.faq_matches(_bench(spark, sf_dir), faq, "item_id", "text", "faq_id", "faq_text", least=0.1), "overlap")


@register("expand_combined", f"""WITH {SCORED}, p AS (SELECT b20.item_id, {sql_query_tokens('q.text', True)} AS own, {sql_query_tokens('d.text', True)} AS ctx FROM b20 JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = b20.item_id WHERE rank = 1),
t AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, own, unnest(ctx) AS term FROM p) WHERE length(term) > 2 AND NOT list_contains(own, term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, term) AS place FROM t),
d AS ({_decompose_sql()}),
u AS (SELECT item_id, lower(term) AS term, 0.5::DOUBLE AS weight FROM r WHERE place <= 10 UNION ALL SELECT item_id, lower(term), weight FROM d),
m AS (SELECT item_id, term, max(weight) AS weight FROM u GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(weight, 6) DESC, term) AS place FROM m)
SELECT item_id, term, round(weight, 6) AS weight, place FROM z WHERE place <= 10""")
def expand_combined(spark, sf_dir):
    context = expand_context(spark, sf_dir).select("item_id", "term", F.lit(0.5).alias("weight"))
    parts = expansion.decomposed(_bench(spark, sf_dir), "item_id", "text")
    return _rounded(expansion.combined([context, parts], "item_id"), "weight")


# --- retrieval metrics: vectors with the query's label are relevant

KS = [1, 3, 5, 10]
_EVAL = """
q AS (SELECT vec_id AS query_id, label AS ql, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
rel AS (SELECT query_id, vec_id AS id FROM q JOIN embeddings ON label = ql AND vec_id <> query_id),
s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) - 1 AS rank FROM s) WHERE rank BETWEEN 1 AND 10),
j AS (SELECT r.query_id, r.id, rank, CASE WHEN rel.id IS NULL THEN 0 ELSE 1 END AS hit, coalesce(n, 0) AS n FROM r LEFT JOIN rel USING (query_id, id) LEFT JOIN (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id) USING (query_id)),
c AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM j)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    queries = vecs.where("vec_id % 20 = 0")
    found = vectors.knn(vecs, queries, 11).withColumn("rank", F.col("rank") - 1).where("rank BETWEEN 1 AND 10")
    return evaluation.per_query(evaluation.judged_by_label(found, vecs, "query_id", "id", "vec_id", "label"), "query_id", KS)


def _per_k(name: str, expr: str) -> str:
    return ", ".join(f"round({expr.format(k=k)}, 6) AS {name}_{k}" for k in KS)


_P, _R = "sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) / {k}", "CASE WHEN max(n) > 0 THEN sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) / max(n) ELSE 0 END"
_PT = "sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) / greatest(1, least({k}, count(*)))"
_N = "sum(CASE WHEN rank <= {k} THEN hit / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, greatest(1, least({k}, max(n))) + 1), lambda i: 1.0 / log2(i + 1)))"
_MRR = "round(coalesce(max(CASE WHEN hit = 1 THEN 1.0 / rank END), 0), 6) AS rr"
_AP = "round(CASE WHEN max(n) > 0 THEN sum(CASE WHEN hit = 1 THEN run / rank ELSE 0 END) / max(n) ELSE 0 END, 6) AS ap"


def _eval(name: str, sql: str, *cols: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(_metrics(spark, sf_dir).select("query_id", *cols), *cols)

    register(name, f"WITH {_EVAL} SELECT query_id, {sql} FROM c GROUP BY query_id")(query)


_eval("eval_mrr", _MRR, "rr")
_eval("eval_map", _AP, "ap")
_eval("eval_precision_at_k", _per_k("precision", _P), *(f"precision_{k}" for k in KS))
_eval("eval_precision_text", _per_k("precision_text", _PT), *(f"precision_text_{k}" for k in KS))
_eval("eval_recall_at_k", _per_k("recall", _R), *(f"recall_{k}" for k in KS))
_eval("eval_ndcg", _per_k("ndcg", _N), *(f"ndcg_{k}" for k in KS))


@register("eval_summary", f"WITH {_EVAL}, g AS (SELECT query_id, {_MRR.replace('round(', '(').replace(', 6)', ')')}, {_AP.replace('round(', '(').replace(', 6)', ')')} FROM c GROUP BY query_id) SELECT round(avg(rr), 6) AS mrr, round(avg(ap), 6) AS map FROM g")
def eval_summary(spark, sf_dir):
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    m = evaluation.means(_metrics(spark, sf_dir), queries, "query_id")
    return m.select(F.round("rr", 6).alias("mrr"), F.round("ap", 6).alias("map"))


# --- text pairs: an assistant's turn against the user's turn before it

_PAIRS = "p AS (SELECT b.conv_id * 100 + b.turn AS pair_id, b.text AS candidate, a.text AS reference FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    a = t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    b = t.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("candidate"))
    return b.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("pair_id"), "candidate", "reference")


_MT = {s: sql_metric_tokens(s) for s in ("candidate", "reference")}


@register("gen_token_f1", f"WITH {_PAIRS}, t AS (SELECT pair_id, list_distinct({_MT['candidate']}) AS a, list_distinct({_MT['reference']}) AS b FROM p) SELECT pair_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 100.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 200.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM t")
def gen_token_f1(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair_id", F.round(evaluation.token_f1("candidate", "reference"), 6).alias("f1"))


@register("gen_exact_match", f"WITH {_PAIRS} SELECT pair_id, CASE WHEN array_to_string({_MT['candidate']}, ' ') = array_to_string({_MT['reference']}, ' ') THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS exact FROM p")
def gen_exact_match(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair_id", evaluation.exact_match("candidate", "reference").alias("exact"))


def _ngram_sql(n: int) -> str:
    g = lambda s: f"CASE WHEN len({s}) >= {n} THEN list_transform(range(1, len({s}) - {n} + 2), lambda i: array_to_string({s}[i:i + {n} - 1], ' ')) ELSE []::VARCHAR[] END"
    return f"""{_PAIRS}, t AS (SELECT pair_id, {_MT['candidate']} AS ct, {_MT['reference']} AS rt FROM p), g AS (SELECT pair_id, {g('ct')} AS c, {g('rt')} AS r FROM t),
u AS (SELECT pair_id, unnest(c) AS g, 1 AS c, 0 AS r FROM g UNION ALL SELECT pair_id, unnest(r), 0, 1 FROM g), k AS (SELECT pair_id, g, sum(c) AS c, sum(r) AS r FROM u GROUP BY ALL), o AS (SELECT pair_id, sum(least(c, r)) AS o FROM k GROUP BY pair_id),
x AS (SELECT g.pair_id, coalesce(o, 0) AS o, len(c) AS nc, len(r) AS nr FROM g LEFT JOIN o USING (pair_id)),
y AS (SELECT pair_id, CASE WHEN nc > 0 THEN o / nc ELSE 0 END AS p, CASE WHEN nr > 0 THEN o / nr ELSE 0 END AS r FROM x)"""


for _n in (1, 2):

    def _rouge(spark: SparkSession, sf_dir: str, n: int = _n) -> DataFrame:
        return _rounded(evaluation.rouge_n(_pairs(spark, sf_dir), "pair_id", "candidate", "reference", n), "precision", "recall", "f1")

    register(f"gen_rouge{_n}", f"WITH {_ngram_sql(_n)} SELECT pair_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM y")(_rouge)


@register("gen_ngram_precision", f"WITH {_ngram_sql(4)} SELECT pair_id, round(p, 6) AS precision FROM y")
def gen_ngram_precision(spark, sf_dir):
    return _rounded(evaluation.rouge_n(_pairs(spark, sf_dir), "pair_id", "candidate", "reference", 4).select("pair_id", "precision"), "precision")


@register("gen_bleu_rougel_meteor")
def gen_bleu_rougel_meteor(spark, sf_dir):
    return _rounded(evaluation.generation_scores(_pairs(spark, sf_dir), "pair_id", "candidate", "reference"), "bleu", "rouge_l", "meteor")


_CONTRAST = " + ".join(f"len(regexp_extract_all(coalesce(text, ''), '(?i){p}'))" for p in text.CONTRAST)


@register("gen_contradiction", f"WITH s AS (SELECT doc_id, text, len({_SENT.format('text')}) AS n FROM documents) SELECT doc_id, round(CASE WHEN n < 2 THEN 0.0 ELSE least(1.0, ({_CONTRAST}) / (n - 1)) END, 6) AS contradiction FROM s")
def gen_contradiction(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(text.contradiction_density("text"), 6).alias("contradiction"))


# --- relevance and faithfulness


@register("rel_tfidf", f"WITH {SCORED} SELECT item_id, doc_id, round(tfidf.score, 6) AS score, tfidf.score >= 0.3 AS relevant FROM b20 JOIN tfidf USING (item_id, doc_id)")
def rel_tfidf(spark, sf_dir):
    rows = _both(spark, sf_dir).select("item_id", "doc_id", F.col("tfidf").alias("score"))
    return rows.select("item_id", "doc_id", F.round("score", 6).alias("score"), (F.col("score") >= 0.3).alias("relevant"))


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _both(spark, sf_dir).select("item_id", "doc_id", F.least(F.lit(1.0), F.col("bm25") / 10).alias("bm25"), "tfidf")
    both = [F.col("tfidf"), F.col("bm25")]
    return rows.select("item_id", "doc_id", evaluation.weighted_mean(both, [0.3, 0.3]).alias("score"), evaluation.agreement(both).alias("confidence"))


_HYB = f"{SCORED}, h AS (SELECT item_id, doc_id, tfidf.score AS a, least(1.0, b20.score / 10) AS b FROM b20 JOIN tfidf USING (item_id, doc_id))"


@register("rel_hybrid", f"WITH {_HYB} SELECT item_id, doc_id, round((a + b) / 2, 6) AS score, round(greatest(0.0, 1.0 - abs(a - b) / 2), 6) AS confidence FROM h")
def rel_hybrid(spark, sf_dir):
    return _rounded(_hybrid(spark, sf_dir), "score", "confidence")


@register("rel_aggregate", f"WITH {_HYB}, s AS (SELECT item_id, (a + b) / 2 AS score FROM h) SELECT item_id, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS lowest, round(max(score), 6) AS highest, round(avg((score >= 0.5)::INT), 6) AS positive_ratio FROM s GROUP BY item_id")
def rel_aggregate(spark, sf_dir):
    return _rounded(evaluation.aggregate_scores(_hybrid(spark, sf_dir), "score", F.col("score") >= 0.5, "item_id"), "mean", "std", "lowest", "highest", "positive_ratio")


@register("rel_semantic", "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) AS s FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM s) SELECT query_id, id, round(s, 6) AS score, s >= 0.5 AS relevant, round(greatest(0.0, least(1.0, 1.0 - abs(s - 0.5) / 0.5)), 6) AS confidence FROM r WHERE rank <= 5")
def rel_semantic(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    s = F.col("score")
    return vectors.knn(vecs, vecs.where("vec_id % 20 = 0"), 5).select("query_id", "id", F.round(s, 6).alias("score"), (s >= 0.5).alias("relevant"), F.round(evaluation.threshold_confidence(s, 0.5), 6).alias("confidence"))


def _overlap_sql(c: str) -> str:
    strip = r"""regexp_replace(x, '^[.,!?;:()\[\]{}"'']+|[.,!?;:()\[\]{}"'']+$', '', 'g')"""
    return f"list_distinct(list_filter(list_transform({sql_words(f'lower({c})')}, lambda x: {strip}), lambda x: x <> '' AND x NOT IN ({STOP})))"


@register("faith_token", f"""WITH {_PAIRS}, t AS (SELECT pair_id, {_overlap_sql('candidate')} AS a, {_overlap_sql('reference')} AS b FROM p), n AS (SELECT pair_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS n FROM t)
SELECT pair_id, round(CASE WHEN na > 0 AND nb > 0 THEN n / na ELSE 0 END, 6) AS precision, round(CASE WHEN na > 0 AND nb > 0 THEN n / nb ELSE 0 END, 6) AS recall, round(CASE WHEN na > 0 AND nb > 0 THEN 2.0 * n / (na + nb) ELSE 0 END, 6) AS f1, round(CASE WHEN na > 0 AND nb > 0 THEN n / greatest(na, nb) ELSE 0 END, 6) AS coverage, CASE WHEN na > 0 AND nb > 0 THEN 2.0 * n / (na + nb) >= 0.3 ELSE FALSE END AS faithful FROM n""")
def faith_token(spark, sf_dir):
    s = evaluation.overlap_scores("candidate", "reference")
    return _pairs(spark, sf_dir).select("pair_id", *(F.round(c, 6).alias(n) for n, c in s.items()), (s["f1"] >= 0.3).alias("faithful"))


_T = " OR ".join(f"regexp_matches(s, '(?i){p}')" for p in evaluation.TEMPORAL)
_NU = " OR ".join(f"regexp_matches(s, '{p}')" for p in evaluation.NUMERICAL)


@register("faith_claim_flags", f"WITH x AS (SELECT doc_id, {_SENT.format('text')} AS ss FROM documents), s AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM x) SELECT doc_id, CAST(i AS BIGINT) AS sentence_index, ({_T}) AS temporal, ({_NU}) AS numerical FROM s WHERE len({sql_words('s')}) > 5")
def faith_claim_flags(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(text.sentences("text")).alias("i", "s")).where(F.size(text.words("s")) > 5)
    flags = evaluation.claim_flags("s")
    return rows.select("doc_id", F.col("i").cast("long").alias("sentence_index"), flags["temporal"].alias("temporal"), flags["numerical"].alias("numerical"))


@register("faith_claims")
def faith_claims(spark, sf_dir):
    return evaluation.claims(_docs(spark, sf_dir), "doc_id", "text")


@register("faith_semantic_agg", """WITH s AS (SELECT a.vec_id AS id, a.label, max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS best FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(best), 6) AS mean, round(stddev_pop(best), 6) AS std, round(min(best), 6) AS lowest, round(max(best), 6) AS highest, round(avg((best >= 0.7)::INT), 6) AS positive_ratio FROM s GROUP BY label""")
def faith_semantic_agg(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    rows = proximity.nearest_within(vecs, vecs.where("vec_id % 20 = 0"), "label", 2)
    best = rows.where("query_id <> id").groupBy("query_id").agg(F.max("score").alias("best")).join(vecs.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return _rounded(evaluation.aggregate_scores(best, "best", F.col("best") >= 0.7, "label"), "mean", "std", "lowest", "highest", "positive_ratio")


# --- response processing


@register("clean_basic", rf"""WITH a AS (SELECT doc_id, {sql_strip("regexp_replace(regexp_replace(coalesce(text, ''), '(?s)<think>.*?</think>', '', 'g'), '(?s)\\[THINK\\].*?\\[/THINK\\]', '', 'g')")} AS t FROM documents)
SELECT doc_id, {sql_strip("regexp_replace(regexp_replace(regexp_replace(t, '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '\\s+([.,!?;:])', '\\1', 'g')")} AS cleaned FROM a""".replace("\\\\", "\\"))
def clean_basic(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.clean("text").alias("cleaned"))


@register("clean_markdown", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
'\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '__([^_]+)__', '\1', 'g'), '_([^_]+)_', '\1', 'g'), '\[([^\]]+)\]\([^\)]+\)', '\1', 'g'), '(?s)```.*?```', '', 'g'), '`([^`]+)`', '\1', 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM documents""")
def clean_markdown(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.remove_markdown("text").alias("cleaned"))


@register("clean_aggressive")
def clean_aggressive(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.clean("text", aggressive=True).alias("cleaned"))


_RESPONSES = [
    (1, 'Here: ```json\n{"a": 1}\n```'), (2, "- one\n* two\n3. three\na) four"), (3, "```python\nprint(1)\n```\n```\nplain\n```"), (4, "| h1 | h2 |\n|---|---|\n| a | b |\n\nend"),
    (5, "I think it could be 50% of $1,000 by Jan 5, 2024. Always yes, never no. Guess?"), (6, "According to the manual, [Source: doc A] it works. (Source: B)"), (7, "Plain text that answers the question in a few words."), (8, ""), (9, "{}"), (10, "1. first\n2) second"), (11, "I cannot answer that."),
]
_VALUES = "(VALUES " + ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in _RESPONSES) + ") AS r(rid, t)"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with every format, and all turns of the conversations."""
    fixed = spark.createDataFrame(_RESPONSES, "rid long, t string")
    return fixed.union(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn") + 1000).alias("rid"), "text"))


_RESP = f"r AS (SELECT CAST(rid AS BIGINT) AS rid, t FROM {_VALUES} UNION ALL SELECT conv_id * 100 + turn + 1000, text FROM conversations)"
_LINES = f"list_transform(string_split(t, chr(10)), lambda x: {sql_strip('x')})"
_BUL = rf"list_filter({_LINES}, lambda x: regexp_matches(x, '^(?:[-*•]|\d+[.)]|[a-z][.)])\s+(.+)$'))"
_NUM = rf"list_filter({_LINES}, lambda x: regexp_matches(x, '^\d+[.)]\s+(.+)$'))"
_CODE = r"regexp_extract_all(t, '(?s)```(?:\w+)?\s*(.*?)```', 1)"
_TAB = rf"list_filter(string_split(t, chr(10)), lambda x: starts_with({sql_strip('x')}, '|') AND NOT regexp_matches(x, '^[\s|:\-]+$'))"
_JSON = r"regexp_extract(CASE WHEN regexp_extract(t, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1) <> '' THEN regexp_extract(t, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1) ELSE t END, '(?s)(\{.*\})', 1)"


@register("parse_bullets", rf"WITH {_RESP} SELECT rid, array_to_string(list_transform({_BUL}, lambda x: {sql_strip(chr(114) + 'egexp_extract(x, ' + chr(39) + '^(?:[-*•]|' + chr(92) + 'd+[.)]|[a-z][.)])' + chr(92) + 's+(.+)$' + chr(39) + ', 1)')}), '|') AS bullets, CAST(len({_NUM}) AS BIGINT) AS n_numbered FROM r")
def parse_bullets(spark, sf_dir):
    return _responses(spark, sf_dir).select("rid", F.array_join(text.bullet_points("t"), "|").alias("bullets"), F.size(text.numbered_list("t")).cast("long").alias("n_numbered"))


@register("parse_code", f"WITH {_RESP} SELECT rid, array_to_string(list_transform({_CODE}, lambda x: {sql_strip('x')}), '|') AS code FROM r")
def parse_code(spark, sf_dir):
    return _responses(spark, sf_dir).select("rid", F.array_join(text.code_blocks("t"), "|").alias("code"))


@register("parse_table", f"WITH {_RESP} SELECT rid, array_to_string(list_transform({_TAB}, lambda x: array_to_string(list_transform(string_split(x, '|')[2:len(string_split(x, '|')) - 1], lambda y: {sql_strip('y')}), ',')), ';') AS cells FROM r")
def parse_table(spark, sf_dir):
    return _responses(spark, sf_dir).select("rid", F.array_join(F.transform(text.table_cells("t"), lambda r: F.array_join(r, ",")), ";").alias("cells"))


@register("parse_json", f"WITH {_RESP} SELECT rid, CASE WHEN {_JSON} <> '' AND json_valid({_JSON}) THEN {_JSON} END AS json FROM r")
def parse_json(spark, sf_dir):
    return _responses(spark, sf_dir).select("rid", text.json_object("t").alias("json"))


@register("detect_format", rf"WITH {_RESP} SELECT rid, CASE WHEN {_JSON} <> '' AND json_valid({_JSON}) AND NOT regexp_matches({_JSON}, '^\{{\s*\}}$') THEN 'json' WHEN len({_BUL}) > 0 THEN 'bullet_points' WHEN len({_NUM}) > 0 THEN 'numbered_list' WHEN len({_CODE}) > 0 THEN 'code' WHEN len({_TAB}) > 0 THEN 'table' ELSE 'text' END AS format FROM r")
def detect_format(spark, sf_dir):
    return _responses(spark, sf_dir).select("rid", text.detect_format("t").alias("format"))


def _any(c: str, phrases: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(c, p.replace("'", "''")) for p in phrases) + ")"


_CONF = f"1.0::DOUBLE - CASE WHEN {_any('lower(t)', text.LOW_CONFIDENCE)} THEN 0.15 ELSE 0 END - CASE WHEN {_any('lower(t)', text.HEDGING)} THEN 0.1 ELSE 0 END" + "".join(f" - CASE WHEN contains(lower(t), '{m}') THEN 0.05 ELSE 0 END" for m in text.UNCERTAIN) + rf" - CASE WHEN len({sql_words('t')}) < 5 THEN 0.2 ELSE 0 END + CASE WHEN ends_with({sql_strip('t')}, '.') THEN 0.05 ELSE 0 END - CASE WHEN {_any('lower(t)', text.NO_ANSWER)} THEN 0.3 ELSE 0 END"


@register("confidence", f"WITH {_RESP} SELECT rid, round(greatest(0.0, least(1.0, {_CONF})), 6) AS confidence FROM r")
def confidence(spark, sf_dir):
    return _responses(spark, sf_dir).select("rid", F.round(text.confidence("t"), 6).alias("confidence"))


_H0 = "0.0::DOUBLE" + "".join(f" + CASE WHEN regexp_matches(t, '{p}') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END" for p in text.CLAIM_PATTERNS)
_OPP = " OR ".join(rf"(regexp_matches(lower(t), '\b{a}\b') AND regexp_matches(lower(t), '\b{b}\b'))" for a, b in text.OPPOSITES)


@register("hallucination", f"""WITH {_RESP}, a AS (SELECT rid, t, {_H0} AS s FROM r), b AS (SELECT rid, t, s + CASE WHEN s > 0.2::DOUBLE AND NOT {_any('lower(t)', text.HEDGE_WORDS)} THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS s FROM a),
c AS (SELECT rid, t, s + CASE WHEN len({sql_words('t')}) > 100 AND s > 0.3::DOUBLE THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS s FROM b), d AS (SELECT rid, least(1.0::DOUBLE, s + CASE WHEN {_OPP} THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM c)
SELECT rid, round(s, 6) AS score, s > 0.3::DOUBLE AS flagged FROM d""")
def hallucination(spark, sf_dir):
    h = text.hallucination("t")
    return _responses(spark, sf_dir).select("rid", F.round(h, 6).alias("score"), (h > 0.3).alias("flagged"))


_CITE = "list_sort(list_distinct(list_transform(list_concat(" + ", ".join(f"regexp_extract_all(t, '(?i){p}', 1)" for p in text.CITATIONS) + f"), lambda x: {sql_strip('x')})))"


@register("sources", f"WITH {_RESP} SELECT rid, array_to_string({_CITE}, '|') AS sources FROM r")
def sources(spark, sf_dir):
    return _responses(spark, sf_dir).select("rid", F.array_join(text.citations("t"), "|").alias("sources"))


@register("source_validate", f"WITH {_RESP}, s AS (SELECT rid, unnest({_CITE}) AS source FROM r) SELECT rid, source FROM s WHERE EXISTS (SELECT 1 FROM (VALUES ('manual'), ('Doc A, page 3'), ('b')) AS v(a) WHERE contains(lower(a), lower(source)) OR contains(lower(source), lower(a)))")
def source_validate(spark, sf_dir):
    known = spark.createDataFrame([("manual",), ("Doc A, page 3",), ("b",)], "available string")
    cited = _responses(spark, sf_dir).select("rid", F.explode(text.citations("t")).alias("source"))
    a, b = F.lower("available"), F.lower("source")
    # The list of available sources is a parameter of three rows.
    return cited.join(F.broadcast(known), F.contains(a, b) | F.contains(b, a), "left_semi")


_WS = sql_strip("regexp_replace(regexp_replace(regexp_replace(t, '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '\\s+([.,!?;:])', '\\1', 'g')")
_THINK = sql_strip("regexp_replace(regexp_replace(coalesce(t, ''), '(?s)<think>.*?</think>', '', 'g'), '(?s)\\[THINK\\].*?\\[/THINK\\]', '', 'g')")
_FORMAT = rf"CASE WHEN {_JSON} <> '' AND json_valid({_JSON}) AND NOT regexp_matches({_JSON}, '^\{{\s*\}}$') THEN 'json' WHEN len({_BUL}) > 0 THEN 'bullet_points' WHEN len({_NUM}) > 0 THEN 'numbered_list' WHEN len({_CODE}) > 0 THEN 'code' WHEN len({_TAB}) > 0 THEN 'table' ELSE 'text' END"


@register("process_responses", f"""WITH {_RESP}, k AS (SELECT rid, coalesce(t, '') <> '' AS full_, {_THINK} AS t FROM r), z AS (SELECT rid, full_, {_WS} AS t FROM k), a AS (SELECT *, {_H0} AS s FROM z),
b AS (SELECT rid, full_, t, s + CASE WHEN s > 0.2::DOUBLE AND NOT {_any('lower(t)', text.HEDGE_WORDS)} THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS s FROM a),
c AS (SELECT rid, full_, t, s + CASE WHEN len({sql_words('t')}) > 100 AND s > 0.3::DOUBLE THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS s FROM b), d AS (SELECT rid, full_, t, least(1.0::DOUBLE, s + CASE WHEN {_OPP} THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM c)
SELECT rid, CASE WHEN full_ THEN t ELSE '' END AS cleaned, CASE WHEN full_ THEN {_FORMAT} ELSE 'text' END AS format, round(CASE WHEN full_ THEN greatest(0.0, least(1.0, {_CONF})) ELSE 0.0 END, 6) AS confidence,
round(CASE WHEN full_ THEN s ELSE 0.0 END, 6) AS hallucination_score, full_ AND s > 0.3::DOUBLE AS has_hallucination, CASE WHEN full_ THEN array_to_string({_CITE}, '|') ELSE '' END AS sources FROM d""")
def process_responses(spark, sf_dir):
    rows = responses.processed(_responses(spark, sf_dir).withColumn("context", F.lit("given")), "t", "context")
    return rows.select("rid", "cleaned", "format", F.round("confidence", 6).alias("confidence"), F.round("hallucination_score", 6).alias("hallucination_score"), "has_hallucination", F.array_join("sources", "|").alias("sources"))


@register("faith_method_token", f"""WITH {_PAIRS}, o AS (SELECT pair_id, {_overlap_sql('candidate')} AS a, {_overlap_sql('reference')} AS b FROM p),
s AS (SELECT pair_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0.0 END AS f FROM o)
SELECT pair_id, round(f, 6) AS score, round(greatest(0.0, least(1.0, 1.0 - abs(f - 0.5) / 0.5)), 6) AS confidence, f >= 0.5 AS faithful FROM s""")
def faith_method_token(spark, sf_dir):
    return _rounded(evaluation.faithfulness(_pairs(spark, sf_dir), "candidate", "reference", "token").select("pair_id", "score", "confidence", "faithful"), "score", "confidence")


# --- validation

_SAMPLES = ["a.b@c.org", "bad@", "123e4567-e89b-12d3-a456-426614174000", "user_name-1", "ab", "my-slug-2", "#a0B1c2", "https://example.com/x?y=1", "http:///x", "10.0.0.1", "1.2.3", "doc_abcDEF123", "session_1", "query_abcdefgh", "Passw0rd!", "password", "", "x" * 30]
_SV = "(VALUES " + ", ".join(f"('{s}')" for s in _SAMPLES) + ") AS s(v)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s in _SAMPLES], "v string").union(table(spark, sf_dir, "pages").select("url"))


_SQ = f"s AS (SELECT v FROM {_SV} UNION ALL SELECT url FROM pages)"


@register("validate_patterns", f"WITH {_SQ} SELECT v, " + ", ".join(f"regexp_matches(v, '{p}') AS is_{n}" for n, p in text.PATTERNS.items()) + " FROM s")
def validate_patterns(spark, sf_dir):
    return _samples(spark, sf_dir).select("v", *(text.matches("v", n).alias(f"is_{n}") for n in text.PATTERNS))


_PC = " + ".join(f"regexp_matches(v, '{p}')::INT" for p in text.PASSWORD_CLASSES)


@register("password_class", f"WITH {_SQ} SELECT v, length(v) >= 8 AND ({_PC}) >= 3 AS strong FROM s")
def password_class(spark, sf_dir):
    return _samples(spark, sf_dir).select("v", text.strong_password("v").alias("strong"))


@register("sanitise_query", rf"SELECT doc_id, {sql_strip('substr(regexp_replace(text, ' + chr(39) + '[<>{}' + chr(39) * 2 + chr(34) + ';|&$`]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + '), 1, 1000)')} AS query FROM documents")
def sanitise_query(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.sanitize_query("text").alias("query"))


_HTML = "substr(html, 1, 10000)"
for _raw, _safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _HTML = f"replace({_HTML}, '{_raw}', '{_safe}')"


@register("sanitise_input", rf"SELECT page_id, regexp_replace({_HTML}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS safe FROM pages")
def sanitise_input(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_input("html").alias("safe"))


@register("safe_names", rf"WITH {_SQ} SELECT v, NOT (contains(v, '..') OR contains(v, '/') OR contains(v, '\')) AND length(v) <= 255 AS safe, regexp_replace(v, '[^a-zA-Z0-9_]', '', 'g') AS identifier, CASE WHEN regexp_matches(v, '^[a-zA-Z0-9_]+( ASC| DESC)?$') THEN v ELSE 'id ASC' END AS order_by, lower(trim(string_split(v, ';')[1])) IN ('password', 'ab') AS allowed FROM s")
def safe_names(spark, sf_dir):
    return _samples(spark, sf_dir).select("v", text.safe_file_name("v").alias("safe"), text.sanitize_identifier("v").alias("identifier"), text.sanitize_order_by("v").alias("order_by"), text.allowed_content_type("v", ["password", "ab"]).alias("allowed"))

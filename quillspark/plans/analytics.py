"""Queries on experiments, feedback, versions, metrics, sessions, fine-tuning rows, sources and relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import analytics, prompts
from quillspark.plans.registry import register
from quillspark.plans.retrieval import SCORED, _bm25, _rounded
from quillspark.session import shared_path, table
from quillspark.sources import readers
from quillspark.streaming import sessions

VARIANTS = [("control", 0.5), ("short", 0.3), ("long", 0.2)]
_BUCKET = " + ".join(f"(('0x' || substr(md5('exp_1:' || user_id), {1 + 8 * k}, 8))::BIGINT % 10000) * {16 ** (8 * (3 - k)) % 10000}" for k in range(4))
_ASSIGN = f"u AS (SELECT user_id, CAST(({_BUCKET}) % 10000 AS BIGINT) AS bucket FROM (SELECT DISTINCT user_id FROM events)), a AS (SELECT *, CASE WHEN bucket / 10000 <= 0.5::DOUBLE THEN 'control' WHEN bucket / 10000 <= 0.5::DOUBLE + 0.3::DOUBLE THEN 'short' WHEN bucket / 10000 <= 0.5::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE THEN 'long' ELSE 'long' END AS variant FROM u)"
_STATS = f"{_ASSIGN}, s AS (SELECT variant, count(*) AS n, avg((event_type <> 'error')::INT) AS sr, avg(value / 100) AS m, stddev_samp(value / 100) AS sd, avg(value) AS ml, stddev_samp(value) AS sl FROM events JOIN a USING (user_id) GROUP BY variant)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.assign(_events(spark, sf_dir).select("user_id").distinct(), "exp_1", "user_id", VARIANTS)


@register("ab_assign", f"WITH {_ASSIGN} SELECT user_id, bucket, variant FROM a")
def ab_assign(spark, sf_dir):
    return _assigned(spark, sf_dir)


def _variant_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).join(_assigned(spark, sf_dir), "user_id")
    results = rows.select("variant", (F.col("event_type") != "error").alias("success"), (F.col("value") / 100).alias("score"), F.col("value").alias("latency"))
    return analytics.variant_stats(results, spark.createDataFrame([(v,) for v, _ in [*VARIANTS, ("unused", 0.0)]], "variant string"))


@register("ab_variant_stats", f"WITH {_STATS}, v AS (SELECT unnest(['control', 'short', 'long', 'unused']) AS variant) SELECT variant, coalesce(n, 0) AS n, round(coalesce(sr, 0), 6) AS success_rate, round(coalesce(m, 0), 6) AS avg_score, round(coalesce(sd, 0), 6) AS std_score, round(coalesce(ml, 0), 6) AS avg_latency, round(coalesce(sl, 0), 6) AS std_latency FROM v LEFT JOIN s USING (variant)")
def ab_variant_stats(spark, sf_dir):
    return _rounded(_variant_stats(spark, sf_dir), "success_rate", "avg_score", "std_score", "avg_latency", "std_latency")


@register("ab_significance", f"WITH {_STATS}, r AS (SELECT *, row_number() OVER (ORDER BY round(m, 6) DESC, variant) AS k FROM s), x AS (SELECT * FROM r WHERE k = 1), y AS (SELECT * FROM r WHERE k = 2) SELECT x.variant AS best, round(x.m - y.m, 6) AS lead, x.m - y.m > 0.05 AS significant, round((x.m - y.m) / sqrt(x.sd * x.sd / x.n + y.sd * y.sd / y.n), 5) AS welch_t FROM x, y")
def ab_significance(spark, sf_dir):
    s = analytics.significance(_variant_stats(spark, sf_dir).where("n > 0"))
    return s.select("best", F.round("lead", 6).alias("lead"), "significant", F.round("welch_t", 5).alias("welch_t"))


_FEED = "f AS (SELECT event_id, ts, event_type AS kind, CASE WHEN value < 5 THEN 'very_bad' WHEN value < 15 THEN 'bad' WHEN value < 40 THEN 'neutral' WHEN value < 90 THEN 'good' ELSE 'very_good' END AS rating, 'source' || (user_id % 3) AS source, value / 100 AS score FROM events)"


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rating = F.when(v < 5, "very_bad").when(v < 15, "bad").when(v < 40, "neutral").when(v < 90, "good").otherwise("very_good")
    return _events(spark, sf_dir).select("event_id", "ts", F.col("event_type").alias("kind"), rating.alias("rating"), F.concat(F.lit("source"), (F.col("user_id") % 3).cast("string")).alias("source"), (v / 100).alias("score"))


@register("feedback_stats", f"WITH {_FEED} SELECT count(*) AS n, round(avg(score), 6) AS avg_score, round(avg(CASE rating WHEN 'very_bad' THEN 1 WHEN 'bad' THEN 2 WHEN 'neutral' THEN 3 WHEN 'good' THEN 4 ELSE 5 END), 6) AS avg_rating FROM f")
def feedback_stats(spark, sf_dir):
    return _feedback(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.avg(analytics.rating_value("rating")), 6).alias("avg_rating"))


@register("feedback_distributions", f"WITH {_FEED} SELECT 'rating' AS dimension, rating AS level, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'kind', kind, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM f GROUP BY ALL")
def feedback_distributions(spark, sf_dir):
    return analytics.distributions(_feedback(spark, sf_dir), "rating", "kind", "source")


@register("feedback_page", f"WITH {_FEED} SELECT event_id, kind, rating FROM f WHERE rating = 'good' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 25")
def feedback_page(spark, sf_dir):
    rows = _feedback(spark, sf_dir).where("rating = 'good'")
    return analytics.page(rows, [F.col("ts").desc(), F.col("event_id")], 2, 25).select("event_id", "kind", "rating")


# --- versions: the orders of a customer are the versions of one document

_CONTENT = "o_orderpriority || ' ' || o_orderstatus || ' ' || o_orderkey"
_VERS = f"v AS (SELECT o_custkey AS document, o_orderkey AS version, {_CONTENT} AS content, row_number() OVER w AS version_number, lag(o_orderkey) OVER w AS parent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat_ws(" ", "o_orderpriority", "o_orderstatus", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("version"), content.alias("content"), "o_orderdate")
    return analytics.versions(rows, "document", [F.col("o_orderdate"), F.col("version")], "content", "version").drop("o_orderdate")


@register("version_history", f"WITH {_VERS} SELECT document, version, content, version_number, parent, sha256(content) AS hash, CAST(strlen(content) AS BIGINT) AS size_bytes FROM v")
def version_history(spark, sf_dir):
    return _versions(spark, sf_dir)


@register("version_latest", f"WITH {_VERS} SELECT document, max_by(version, version_number) AS version, max(version_number) AS version_number FROM v GROUP BY document")
def version_latest(spark, sf_dir):
    return analytics.latest(_versions(spark, sf_dir), "document").select("document", "version", "version_number")


@register("version_retention", f"WITH {_VERS}, k AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY version_number DESC) AS r FROM v) SELECT document, version, version_number FROM k WHERE r <= 5")
def version_retention(spark, sf_dir):
    return analytics.latest(_versions(spark, sf_dir), "document", keep=5).select("document", "version", "version_number")


@register("version_rollback", f"WITH {_VERS}, t AS (SELECT document, max(version_number) AS top FROM v GROUP BY document) SELECT document, version_number, parent, content, 'create' AS action FROM v UNION ALL SELECT document, top + 1, version, content, 'restore' FROM v JOIN t USING (document) WHERE version_number = 1")
def version_rollback(spark, sf_dir):
    return analytics.rollback(_versions(spark, sf_dir), "document", 1).select("document", "version_number", "parent", "content", "action")


@register("version_storage", f"WITH {_VERS} SELECT count(*) AS n_versions, count(DISTINCT document) AS n_documents, CAST(sum(strlen(content)) AS BIGINT) AS n_bytes FROM v")
def version_storage(spark, sf_dir):
    return _versions(spark, sf_dir).agg(F.count("*").alias("n_versions"), F.countDistinct("document").alias("n_documents"), F.sum("size_bytes").alias("n_bytes"))


_NEXT = "p AS (SELECT doc_id, coalesce(text, '') AS o, coalesce(lead(text) OVER (ORDER BY doc_id), '') AS n FROM documents)"
_TURN = "p AS (SELECT b.conv_id * 100 + b.turn AS pair_id, a.text AS o, b.text AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    a = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("o"))
    return t.select("conv_id", "turn", F.col("text").alias("n")).join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("pair_id"), "o", "n")


_W = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"


@register("word_diff", f"WITH {_TURN}, w AS (SELECT pair_id, {_W.format('o')} AS a, {_W.format('n')} AS b FROM p), k AS (SELECT pair_id, a, b, len(list_intersect(list_distinct(a), list_distinct(b))) AS c FROM w) SELECT pair_id, CAST(len(a) AS BIGINT) AS words_old, CAST(len(b) AS BIGINT) AS words_new, CAST(len(list_distinct(b)) - c AS BIGINT) AS added, CAST(len(list_distinct(a)) - c AS BIGINT) AS removed, CAST(c AS BIGINT) AS common FROM k")
def word_diff(spark, sf_dir):
    return _turns(spark, sf_dir).select("pair_id", *(c.alias(n) for n, c in analytics.word_diff(F.col("o"), F.col("n")).items()))


@register("char_diff", f"WITH {_TURN}, s AS (SELECT pair_id, length(o) AS a, length(n) AS b, len(list_filter(range(1, least(length(o), length(n)) + 1), lambda i: substr(o, i, 1) = substr(n, i, 1))) AS c FROM p) SELECT pair_id, CAST(b - c AS BIGINT) AS added, CAST(a - c AS BIGINT) AS removed, CAST(c AS BIGINT) AS unchanged, round((a + b - 2 * c) / greatest(1, a + b) * 100, 6) AS change_percentage FROM s")
def char_diff(spark, sf_dir):
    return _rounded(_turns(spark, sf_dir).select("pair_id", *(c.alias(n) for n, c in analytics.character_diff(F.col("o"), F.col("n")).items())), "change_percentage")


@register("line_diff")
def line_diff(spark, sf_dir):
    return analytics.line_diff(_turns(spark, sf_dir), "pair_id", "o", "n").drop("diff")


# --- metrics


@register("metric_summary", "WITH r AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, round(sum(value), 6) AS sum, min(value) AS lowest, max(value) AS highest, round(avg(value), 6) AS mean, arg_max(value, ts) AS last_value FROM events GROUP BY event_type) SELECT event_type, n, v[CAST(floor(n * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(n * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor(n * 0.99) AS BIGINT) + 1] AS p99, sum, lowest, highest, mean, last_value FROM r")
def metric_summary(spark, sf_dir):
    return _rounded(analytics.metric_summary(_events(spark, sf_dir), "event_type", "value", "ts"), "sum", "mean")


@register("metric_rollup", "SELECT event_type, user_id % 5 AS shard, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ROLLUP (event_type, user_id % 5)")
def metric_rollup(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("shard", F.col("user_id") % 5)
    return rows.rollup("event_type", "shard").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@register("loadtest_summary", "WITH r AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS ok, avg(value) AS m, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM events GROUP BY event_type) SELECT event_type, n AS requests, round(ok, 6) AS success_rate, round(m, 6) AS mean, round(n / greatest(s, 1e-9), 9) AS per_second, v[CAST(floor(n * 0.95) AS BIGINT) + 1] AS p95 FROM r")
def loadtest_summary(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    s = analytics.load_summary(rows, "event_type", "value", "ts", F.col("event_type") == "error")
    return s.select("event_type", "requests", F.round("success_rate", 6).alias("success_rate"), F.round("mean", 6).alias("mean"), F.round("per_second", 9).alias("per_second"), "p95")


@register("latency_percentiles", "SELECT event_type, round(avg(value), 6) AS mean, max(value) AS highest, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("highest"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.percentile("value", F.lit(0.99)), 6).alias("p99"))


@register("error_counts", "SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(avg((event_type = 'error')::INT), 6) AS error_ratio FROM events GROUP BY user_id")
def error_counts(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(bad).alias("errors"), F.round(F.avg(bad.cast("double")), 6).alias("error_ratio"))


@register("counters_as_text", "SELECT 'quillspark_requests_total{endpoint=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def counters_as_text(spark, sf_dir):
    return analytics.prometheus_lines(_events(spark, sf_dir).groupBy(F.col("event_type").alias("endpoint")).count(), "requests_total", "endpoint", "count")


@register("tokens_per_second", r"SELECT conv_id, round(avg(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) / (0.5 + turn)), 6) AS tokens_per_second FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def tokens_per_second(spark, sf_dir):
    from quillspark.functions.text import words

    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.groupBy("conv_id").agg(F.round(F.avg(F.size(words("text")) / (0.5 + F.col("turn"))), 6).alias("tokens_per_second"))


@register("batch_summary", "SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS completed, count(*) FILTER (event_type = 'error') AS failed, round(avg((event_type <> 'error')::INT), 6) AS success_rate, round(avg(value), 6) AS avg_ms FROM events")
def batch_summary(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("status", F.when(F.col("event_type") == "error", "failed").otherwise("completed"))
    return _rounded(analytics.batch_summary(rows, "status", "value"), "success_rate", "avg_ms")


# --- sessions, limits, alerts


@register("sessions_batch", "WITH l AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM l) SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY ALL")
def sessions_batch(spark, sf_dir):
    s = sessions.sessions_by_gaps(_events(spark, sf_dir), "user_id", "ts")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return s.select("user_id", "session", us("start").alias("start_us"), us("last").alias("last_us"), "n")


@register("sessions_window", "WITH l AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM l) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, session")
def sessions_window(spark, sf_dir):
    return sessions.sessions(_events(spark, sf_dir), "user_id", "ts").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@register("history_last_n", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations QUALIFY place <= 4")
def history_last_n(spark, sf_dir):
    return sessions.last_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn", "role", "place")


@register("rate_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) <= 2 AS allowed FROM events")
def rate_window(spark, sf_dir):
    return sessions.window_counts(_events(spark, sf_dir), "user_id", "ts", 2, 3600).select("event_id", "in_window", "allowed")


@register("rate_limited")
def rate_limited(spark, sf_dir):
    return sessions.limited(_events(spark, sf_dir), "user_id", "ts", "event_id", 2, 3600.0).select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "allowed")


@register("login_limited")
def login_limited(spark, sf_dir):
    return sessions.limited(_events(spark, sf_dir), "user_id", "ts", "event_id", 2, 3600.0, 7200.0).select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "allowed")


@register("alert_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS requests, round(quantile_cont(value, 0.95), 6) AS p95, round(avg((event_type = 'error')::INT), 6) AS errors, quantile_cont(value, 0.95) > 100 AS slow, avg((event_type = 'error')::INT) > 0.05 AS failing FROM events GROUP BY ALL")
def alert_windows(spark, sf_dir):
    a = sessions.alerts(_events(spark, sf_dir), "ts", "value", F.col("event_type") == "error", "1 hour", 100.0)
    return a.select(F.unix_micros("start").alias("start_us"), "requests", F.round("p95", 6).alias("p95"), F.round("errors", 6).alias("errors"), "slow", "failing")


@register("token_events", r"WITH w AS (SELECT conv_id * 100 + turn AS rid, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'assistant') SELECT rid, CAST(0 AS BIGINT) AS seq, 'start' AS event, '' AS data, 0.0::DOUBLE AS progress FROM w UNION ALL SELECT rid, i, 'token', w[i], round(least(0.9::DOUBLE, 0.5::DOUBLE + (i // 10) * 10 / 100.0 * 0.4::DOUBLE), 6) FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM w) UNION ALL SELECT rid, len(w) + 1, 'done', '', 1.0 FROM w")
def token_events(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("rid"), "text")
    return _rounded(sessions.token_events(rows, "rid", "text"), "progress")


# --- prompts and tokens


@register("prompt_context_budget", f"""WITH {SCORED}, b AS (SELECT item_id, rank, '[Source: ' || doc_id || ']' || chr(10) || text || chr(10) AS block FROM b20 JOIN documents USING (doc_id) WHERE rank <= 10),
r AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
p AS (SELECT item_id, rank, CASE WHEN length(block) <= 4000 - before THEN block WHEN 4000 - before > 100 THEN substr(block, 1, CAST(4000 - before AS BIGINT)) || '...' END AS part FROM r WHERE before < 4000)
SELECT item_id, string_agg(part, chr(10) ORDER BY rank) AS context FROM p WHERE part IS NOT NULL GROUP BY item_id""")
def prompt_context_budget(spark, sf_dir):
    ranked = _bm25(spark, sf_dir, 10).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return prompts.contexts(ranked, "item_id", "text", "doc_id")


@register("prompt_history", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations), s AS (SELECT conv_id, turn, role, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS t FROM l WHERE r <= 10) SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || t, chr(10) ORDER BY turn) AS history FROM s WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def prompt_history(spark, sf_dir):
    return prompts.histories(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@register("prompt_blocks", f"WITH {SCORED} SELECT item_id, string_agg('Document ' || rank || ' (Relevance: ' || format('{{:.3f}}', score) || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS blocks FROM b20 JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY item_id")
def prompt_blocks(spark, sf_dir):
    ranked = _bm25(spark, sf_dir, 3).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return prompts.scored_blocks(ranked, "item_id", "text", "score")


@register("prompt_rag", f"WITH {SCORED} SELECT item_id, 'Answer the question from the context.' || chr(10) || chr(10) || 'Context:' || chr(10) || d.text || chr(10) || chr(10) || 'Question: ' || q.text || chr(10) || chr(10) || 'Answer:' AS prompt FROM b20 JOIN documents d USING (doc_id) JOIN benchmark q USING (item_id) WHERE rank = 1")
def prompt_rag(spark, sf_dir):
    rows = _bm25(spark, sf_dir, 1).join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("context")), "doc_id").join(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question")), "item_id")
    return rows.select("item_id", prompts.fill(prompts.QA_TEMPLATE, context=F.col("context"), question=F.col("question")).alias("prompt"))


@register("token_counts_by_conversation", "SELECT conv_id, CAST(sum(length(text) // 4 + 4) AS BIGINT) AS tokens, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END) AS BIGINT) AS completion FROM conversations GROUP BY conv_id")
def token_counts_by_conversation(spark, sf_dir):
    n = prompts.token_estimate("text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(n + 4).alias("tokens"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("completion"))


@register("token_cost", "WITH t AS (SELECT conv_id, ['gpt-4', 'GPT-4o-mini-x', 'command', 'unknown'][conv_id % 4 + 1] AS model, sum(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) // 4 END) AS p, sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END) AS c FROM conversations GROUP BY conv_id) SELECT conv_id, model, round(CASE WHEN model IN ('gpt-4', 'GPT-4o-mini-x') THEN 0.03::DOUBLE * p / 1000 + 0.06::DOUBLE * c / 1000 WHEN model = 'command' THEN 0.0005::DOUBLE * p / 1000 + 0.0015::DOUBLE * c / 1000 ELSE 0.01::DOUBLE * p / 1000 + 0.02::DOUBLE * c / 1000 END, 9) AS cost FROM t")
def token_cost(spark, sf_dir):
    n = prompts.token_estimate("text")
    bot = F.col("role") == "assistant"
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.when(bot, 0).otherwise(n)).alias("p"), F.sum(F.when(bot, n).otherwise(0)).alias("c"))
    models = F.array(*map(F.lit, ["gpt-4", "GPT-4o-mini-x", "command", "unknown"]))
    named = rows.withColumn("model", F.get(models, (F.col("conv_id") % 4).cast("int")))
    return prompts.with_cost(named, "model", "p", "c").select("conv_id", "model", F.round("cost", 9).alias("cost"))


@register("truncate_prompts", "SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || chr(10) || '[Truncated...]' ELSE text END AS prompt FROM documents")
def truncate_prompts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", prompts.truncate_prompt(F.col("text"), 100).alias("prompt"))


@register("prompt_ab_weights", "WITH r AS (SELECT user_id % 7 AS test, event_type AS variant, count(*) AS uses, avg((value > 20)::INT) AS rate, avg(least(value / 100, 1.0)) AS mean_score FROM events GROUP BY ALL), e AS (SELECT *, exp(2 * (0.7::DOUBLE * rate + 0.3::DOUBLE * mean_score)) AS e FROM r) SELECT test, variant, uses, round(rate, 6) AS rate, round(mean_score, 6) AS mean_score, round(CASE WHEN sum(uses) OVER (PARTITION BY test) > 10 THEN e / sum(e) OVER (PARTITION BY test) ELSE 1.0 / count(*) OVER (PARTITION BY test) END, 6) AS weight FROM e")
def prompt_ab_weights(spark, sf_dir):
    rows = _events(spark, sf_dir).select((F.col("user_id") % 7).alias("test"), F.col("event_type").alias("variant"), "value")
    w = prompts.variant_weights(rows, "test", "variant", F.col("value") > 20, F.least(F.col("value") / 100, F.lit(1.0)))
    return _rounded(w, "rate", "mean_score", "weight")


# --- fine-tuning: a user's turn is the question, the next assistant's turn the answer

_QA = "qa AS (SELECT b.conv_id * 100 + b.turn AS qa_id, a.text AS question, b.text AS answer, CASE WHEN a.turn % 2 = 0 THEN 'Conversation ' || a.conv_id || ' so far' END AS context, 'chat' AS category FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"
_QUAL = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + CASE WHEN length(question) > 10 AND length(answer) > 20 THEN 0.2 ELSE 0 END + CASE WHEN trim(question) <> '' AND trim(answer) <> '' THEN 0.1 ELSE 0 END + CASE WHEN length(coalesce(context, '')) > 20 THEN 0.1 ELSE 0 END + CASE WHEN category <> '' THEN 0.05 ELSE 0 END - CASE WHEN contains(answer, 'PLACEHOLDER') OR contains(answer, 'TODO') THEN 0.3 ELSE 0 END))"


def _qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    a = t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    b = t.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    context = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"), F.lit(" so far")))
    return b.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("qa_id"), "question", "answer", context.alias("context"), F.lit("chat").alias("category"))


def _quality():
    return analytics.qa_quality(F.col("question"), F.col("answer"), F.col("context"), F.col("category"))


@register("ft_quality", f"WITH {_QA} SELECT qa_id, round({_QUAL}, 6) AS quality FROM qa")
def ft_quality(spark, sf_dir):
    return _qa(spark, sf_dir).select("qa_id", F.round(_quality(), 6).alias("quality"))


@register("ft_filter", f"WITH {_QA} SELECT qa_id, question FROM qa WHERE {_QUAL} >= 0.84")
def ft_filter(spark, sf_dir):
    return _qa(spark, sf_dir).where(_quality() >= 0.84).select("qa_id", "question")


_HB = " + ".join(f"(('0x' || substr(md5(CAST(qa_id AS VARCHAR)), {1 + 8 * k}, 8))::BIGINT % 10000) * {16 ** (8 * (3 - k)) % 10000}" for k in range(4))


@register("ft_split", f"WITH {_QA}, h AS (SELECT qa_id, (({_HB}) % 10000) / 10000 AS s FROM qa) SELECT qa_id, CASE WHEN s < 0.8::DOUBLE THEN 'train' WHEN s < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM h")
def ft_split(spark, sf_dir):
    return analytics.split_by_hash(_qa(spark, sf_dir), F.col("qa_id").cast("string")).select("qa_id", "split")


@register("ft_augment", f"WITH {_QA} SELECT qa_id, question, CAST(0 AS BIGINT) AS variation FROM qa UNION ALL SELECT qa_id, regexp_replace(question, '^What', 'Could you explain what'), 1 FROM qa WHERE starts_with(question, 'What') UNION ALL SELECT qa_id, 'Please ' || lower(substr(question, 1, 1)) || substr(question, 2), 2 FROM qa WHERE NOT starts_with(question, 'Please')")
def ft_augment(spark, sf_dir):
    return analytics.augment(_qa(spark, sf_dir), 3).select("qa_id", "question", "variation")


_SYS = "CASE WHEN context IS NOT NULL THEN 'You are a helpful assistant that answers questions based on the provided context.' || chr(10) || chr(10) || 'Context: ' || context ELSE 'You are a helpful assistant that answers questions accurately and concisely.' END"
_INST = "'[INST] ' || CASE WHEN context IS NOT NULL THEN 'Context: ' || context || chr(10) || chr(10) || 'Question: ' || question ELSE question END || ' [/INST] ' || answer"
_STYLES = {
    "openai": f"CAST(json_object('messages', json_array(json_object('role', 'system', 'content', {_SYS}), json_object('role', 'user', 'content', question), json_object('role', 'assistant', 'content', answer))) AS VARCHAR)",
    "llama": f"CAST(json_object('text', {_INST}) AS VARCHAR)",
    "mistral": f"CAST(json_object('text', '<s>' || {_INST} || ' </s>') AS VARCHAR)",
    "sharegpt": f"CAST(json_object('conversations', json_array(json_object('from', 'system', 'value', {_SYS}), json_object('from', 'human', 'value', question), json_object('from', 'gpt', 'value', answer))) AS VARCHAR)",
    "alpaca": "CASE WHEN context IS NULL THEN CAST(json_object('instruction', question, 'output', answer) AS VARCHAR) ELSE CAST(json_object('instruction', question, 'output', answer, 'input', context) AS VARCHAR) END",
    "sql": "'INSERT INTO qa_pairs (question, answer) VALUES (''' || replace(question, '''', '''''') || ''', ''' || replace(answer, '''', '''''') || ''');'",
}
for _style, _sql in _STYLES.items():

    def _rows(spark: SparkSession, sf_dir: str, style: str = _style) -> DataFrame:
        return analytics.chat_rows(_qa(spark, sf_dir), style).select("qa_id", "row")

    register(f"ft_rows_{_style}", f"WITH {_QA} SELECT qa_id, {_sql} AS row FROM qa")(_rows)


@register("ft_chat_rows", "SELECT conv_id, CAST(to_json({'messages': list({'role': role, 'content': text} ORDER BY turn)}) AS VARCHAR) AS row FROM conversations GROUP BY conv_id")
def ft_chat_rows(spark, sf_dir):
    return analytics.conversation_rows(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@register("ft_stats", f"WITH {_QA} SELECT count(*) AS n, round(avg(length(question)), 6) AS avg_question, round(avg(length(answer)), 6) AS avg_answer, count(context) AS n_context FROM qa")
def ft_stats(spark, sf_dir):
    return _qa(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(F.length("question")), 6).alias("avg_question"), F.round(F.avg(F.length("answer")), 6).alias("avg_answer"), F.count("context").alias("n_context"))


# --- sources


@register("html_title", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", readers.html_title("html").alias("title"))


@register("html_counts", r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*href=')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '(?i)<img\b')) AS BIGINT) AS images, CAST(len(regexp_extract_all(html, '(?i)<h[1-6]\b')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(html, '(?i)<p\b')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '(?i)<(?:ul|ol)\b')) AS BIGINT) AS lists FROM pages")
def html_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(n) for n, c in readers.html_counts("html").items()))


@register("html_links", r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1) AS us FROM pages), o AS (SELECT page_id, unnest(us) AS u, unnest(range(len(us))) AS i FROM l), d AS (SELECT page_id, u, min(i) AS i FROM o WHERE u <> '' GROUP BY ALL) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS place, substr(u, 1, 200) AS url FROM d QUALIFY place <= 100""")
def html_links(spark, sf_dir):
    return readers.html_links(table(spark, sf_dir, "pages"), "page_id", "html")


@register("html_metadata", r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)<script.*?</script>|<style.*?</style>', '', 'g') AS body FROM pages),
u AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t, regexp_extract_all(body, '(?is)<h1[^>]*>(.*?)</h1', 1) AS h, regexp_extract_all(body, '(?i)<a\s[^>]*>') AS a FROM b)
SELECT page_id, nullif(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '') AS title, CAST(len(a) AS BIGINT) AS total_links,
CAST(len(regexp_extract_all(body, '(?i)<img[\s/>]')) AS BIGINT) AS total_images, CAST(least(len(h), 10) AS BIGINT) AS n_h1,
array_to_string(list_sort(list_distinct(list_filter(list_transform(a, lambda x: regexp_extract(x, 'href="(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"]+)', 1)), lambda d: d <> '')))[1:20], ' ') AS domains FROM u""")
def html_metadata(spark, sf_dir):
    rows = readers.html_metadata(table(spark, sf_dir, "pages"), "page_id", "html")
    return rows.select("page_id", "title", "total_links", "total_images", F.coalesce(F.size(F.try_element_at("headings", F.lit("h1"))), F.lit(0)).cast("long").alias("n_h1"), F.array_join("linked_domains", " ").alias("domains"))


@register("csv_scan", "SELECT doc_id, lang, source, CAST(length(trim(text)) AS BIGINT) AS n, md5(trim(text)) AS digest, FALSE AS malformed FROM documents")
def csv_scan(spark, sf_dir):
    """The documents through CSV files and back."""
    path = shared_path(spark, "csv")
    readers.export(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), path, "csv")
    rows = readers.read_csv(spark, path)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"), F.col("_malformed").isNotNull().alias("malformed"))


@register("html_text")
def html_text(spark, sf_dir):
    return readers.html_text(table(spark, sf_dir, "pages"), "page_id", "html").drop("domains")


@register("html_sanitised")
def html_sanitised(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", readers.sanitize_html("html").alias("safe"))


@register("csv_render", "SELECT c_custkey + 1 AS row_number, 'Row ' || (c_custkey + 1) || ': c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment || ' | c_nationkey: ' || c_nationkey AS line FROM customer")
def csv_render(spark, sf_dir):
    return readers.rendered_rows(table(spark, sf_dir, "customer"), F.col("c_custkey"), "c_name", "c_mktsegment", "c_nationkey")


@register("csv_types", "SELECT unnest(['c_name', 'c_nationkey', 'c_acctbal', 'd', 'e']) AS \"column\", unnest(['string', 'integer', 'float', 'date', 'empty']) AS type")
def csv_types(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return readers.column_types(c.select("c_name", F.col("c_nationkey").cast("string"), F.format_string("%.2f", "c_acctbal").alias("c_acctbal"), F.lit("2024-01-31").alias("d"), F.lit("").alias("e")))


_DELIM = ", ".join(f"length(substr(text, 1, 5000)) - length(replace(substr(text, 1, 5000), {d}, '')) AS {n}" for d, n in (("','", "comma"), ("';'", "semicolon"), ("'|'", "pipe"), ("' '", "space")))


@register("delimiter_counts", f"SELECT doc_id, {_DELIM} FROM documents")
def delimiter_counts(spark, sf_dir):
    m = readers.delimiter_counts("text")
    return table(spark, sf_dir, "documents").select("doc_id", *(m[d].alias(n) for d, n in ((",", "comma"), (";", "semicolon"), ("|", "pipe"), (" ", "space"))))


@register("sse_frames", "SELECT 'event: ' || event_type || chr(10) || 'id: ' || event_id || chr(10) || 'retry: 1000' || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events")
def sse_frames(spark, sf_dir):
    return _events(spark, sf_dir).select(readers.sse_frames(F.col("event_type"), F.col("props"), F.col("event_id")).alias("frame"))


# --- relational operators


@register("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@register("set_intersect", "SELECT doc_id AS k FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k")).intersect(table(spark, sf_dir, "labels").select("doc_id"))


@register("set_except", "SELECT doc_id AS k FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k")).subtract(table(spark, sf_dir, "labels").select("doc_id"))


@register("semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@register("anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@register("range_join", "SELECT event_id, b.name AS band FROM events JOIN (VALUES ('low', 0.0, 10.0), ('mid', 10.0, 50.0), ('high', 50.0, 100000.0)) AS b(name, lo, hi) ON value >= lo AND value < hi")
def range_join(spark, sf_dir):
    bands = spark.createDataFrame([("low", 0.0, 10.0), ("mid", 10.0, 50.0), ("high", 50.0, 100000.0)], "name string, lo double, hi double")
    # The bands are a parameter of three rows.
    return _events(spark, sf_dir).join(F.broadcast(bands), (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi"))).select("event_id", F.col("name").alias("band"))


@register("asof_join", "WITH p AS (SELECT user_id, ts, event_id AS purchase FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, event_id AS click FROM events WHERE event_type = 'click') SELECT purchase, click FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts")
def asof_join(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = _events(spark, sf_dir).where("event_type IN ('purchase', 'click')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return rows.withColumn("click", last).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "click")


@register("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, sf_dir):
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").groupingSets([[a, b], [a], []], a, b).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register("cube_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").count().withColumnRenamed("count", "n")


@register("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


@register("full_outer", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS has_text, coalesce(l.quality, -1) AS quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def full_outer(spark, sf_dir):
    d, x = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("t")), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(x, "doc_id", "full_outer").select("doc_id", F.coalesce("t", F.lit(False)).alias("has_text"), F.coalesce("quality", F.lit(-1)).alias("quality"))


@register("model_comparison", "WITH s AS (SELECT lang AS model, avg(n_chars) AS quality, avg(length(text) / 100.0) AS latency FROM documents GROUP BY lang) SELECT (SELECT max_by(model, quality) FROM s) AS best_quality, (SELECT min_by(model, latency) FROM s) AS lowest_latency")
def model_comparison(spark, sf_dir):
    s = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("model")).agg(F.avg("n_chars").alias("quality"), F.avg(F.length("text") / 100.0).alias("latency"))
    return s.agg(F.max_by("model", "quality").alias("best_quality"), F.min_by("model", "latency").alias("lowest_latency"))


@register("metadata_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def metadata_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where((F.col("lang") == "en") & (F.col("source") == "src1")).select("doc_id")


@register("clipped_sources", f"WITH {SCORED} SELECT item_id, doc_id, rank, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS excerpt FROM b20 JOIN documents USING (doc_id) WHERE rank <= 5")
def clipped_sources(spark, sf_dir):
    rows = _bm25(spark, sf_dir, 5).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("item_id", "doc_id", "rank", F.when(F.length("text") > 500, F.concat(F.substring("text", 1, 500), F.lit("..."))).otherwise(F.col("text")).alias("excerpt"))

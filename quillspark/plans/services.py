"""Queries on the smaller operators of the ingestion, query and service layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import services
from quillspark.plans.registry import register
from quillspark.plans.retrieval import SCORED, _bm25, _rounded
from quillspark.plans.texts import _SENT
from quillspark.session import table
from quillspark.sources import readers
from quillspark.streaming import conversations, sessions


@register("pack_batches")
def pack_batches(spark, sf_dir):
    return services.pack_batches(table(spark, sf_dir, "documents"), "doc_id", "text")


@register("memory_estimate", "SELECT count(*) AS n_vectors, round(sum(len(embedding) * 4) / 1048576.0, 6) AS mb, CASE WHEN sum(len(embedding) * 4) / 1048576.0 > 1000 THEN 'use an inverted file' WHEN sum(len(embedding) * 4) / 1048576.0 > 100 THEN 'consider an inverted file' ELSE 'exact search is fine' END AS recommendation FROM embeddings")
def memory_estimate(spark, sf_dir):
    return _rounded(services.memory_estimate(table(spark, sf_dir, "embeddings"), "embedding"), "mb")


@register("expand_nearest", "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5 AND score >= 0.7")
def expand_nearest(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return _rounded(services.nearest_terms(v.where("vec_id % 20 = 0"), v, query_id="vec_id", term_id="vec_id"), "score")


_NLI = "n AS (SELECT user_id, ['entailment', 'neutral', 'contradiction'][event_id % 3 + 1] AS label, least(1.0, 0.5 + value / 200) AS p FROM events), s AS (SELECT user_id, CASE label WHEN 'entailment' THEN p WHEN 'neutral' THEN 0.5 + (p - 0.5) / 2 ELSE 1.0 - p END AS s FROM n)"


@register("faith_nli", f"WITH {_NLI} SELECT user_id, round(avg(s), 9) AS score, round(greatest(0.0, 1.0 - stddev_pop(s)), 9) AS confidence, avg(s) >= 0.5 AS faithful FROM s GROUP BY user_id")
def faith_nli(spark, sf_dir):
    labels = F.array(*map(F.lit, ["entailment", "neutral", "contradiction"]))
    rows = table(spark, sf_dir, "events").select("user_id", F.get(labels, (F.col("event_id") % 3).cast("int")).alias("label"), F.least(F.lit(1.0), 0.5 + F.col("value") / 200).alias("p"))
    return services.nli_scores(rows, "user_id", "label", "p").select("user_id", F.round("score", 9).alias("score"), F.round("confidence", 9).alias("confidence"), "faithful")


_KEEP = "CAST(floor(length(text) * (50.0::DOUBLE / greatest(length(text) // 4, 1)) * 0.95::DOUBLE) AS BIGINT)"


@register("truncate_tokens", f"SELECT doc_id, CASE WHEN length(text) // 4 <= 50 THEN text ELSE substr(text, 1, {_KEEP}) END AS head, CASE WHEN length(text) // 4 <= 50 THEN text ELSE substr(text, length(text) - {_KEEP} + 1, {_KEEP}) END AS tail FROM documents")
def truncate_tokens(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", services.truncate_to_tokens(t, 50).alias("head"), services.truncate_to_tokens(t, 50, "start").alias("tail"))


_EXP = "e AS (SELECT user_id AS experiment, min(ts) AS created, count(*) AS done, 100 AS size, CASE WHEN count(*) >= 100 THEN 'completed' WHEN user_id % 3 = 0 THEN 'paused' ELSE 'running' END AS status FROM events GROUP BY user_id)"


def _experiments(spark, sf_dir):
    n = F.count("*")
    status = F.when(n >= 100, "completed").when(F.col("user_id") % 3 == 0, "paused").otherwise("running")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("created"), n.alias("done"), status.alias("status")).select(F.col("user_id").alias("experiment"), "created", "done", F.lit(100).alias("size"), "status")


@register("ab_overview", f"WITH {_EXP} SELECT s.status, count(e.status) AS n FROM (SELECT unnest(['draft', 'running', 'paused', 'completed', 'cancelled']) AS status) s LEFT JOIN e USING (status) GROUP BY s.status")
def ab_overview(spark, sf_dir):
    return services.overview(_experiments(spark, sf_dir), "status")


@register("experiment_list", f"WITH {_EXP} SELECT experiment, done, round(least(100.0, done / 100.0 * 100), 6) AS progress FROM e WHERE status = 'running' ORDER BY created DESC, experiment LIMIT 50")
def experiment_list(spark, sf_dir):
    rows = services.experiments_listed(_experiments(spark, sf_dir), "created", "done", "size", F.col("status") == "running")
    return _rounded(rows.select("experiment", "done", "progress"), "progress")


@register("prompt_filter", "SELECT user_id, event_id FROM events WHERE event_type IN ('click', 'view') AND value > 20 AND user_id % 2 = 0")
def prompt_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.array("event_type").alias("tags"), (F.col("value") > 20).alias("active"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    return services.prompts_with_tags(rows, ["click", "view"], "even").select("user_id", "event_id")


@register("metric_range", "SELECT event_id, value FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-10'")
def metric_range(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'view' AND ts >= TIMESTAMP_NTZ '2024-01-10'").select("event_id", "value")


@register("config_issues", "SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_nationkey > 20 THEN 's_nationkey must be within 0 and 20' END, CASE WHEN s_acctbal < 0 OR s_acctbal > 5000 THEN 's_acctbal must be within 0 and 5000' END], lambda x: x IS NOT NULL), '; ') AS issues FROM supplier")
def config_issues(spark, sf_dir):
    rows = services.config_issues(table(spark, sf_dir, "supplier"), {"s_nationkey": (0, 20), "s_acctbal": (0, 5000)})
    return rows.select("s_suppkey", F.array_join("issues", "; ").alias("issues"))


@register("doc_index_fallback", "SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def doc_index_fallback(spark, sf_dir):
    return services.containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@register("paced_starts", "WITH n AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) SELECT event_id, round(max(t - i / 0.001::DOUBLE) OVER (PARTITION BY user_id ORDER BY i) + i / 0.001::DOUBLE, 3) AS start FROM n")
def paced_starts(spark, sf_dir):
    return services.paced_starts(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 0.001).select("event_id", F.round("start", 3).alias("start"))


@register("retained_points", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 86400 SECOND) SELECT event_id FROM r WHERE k <= 20")
def retained_points(spark, sf_dir):
    now = F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")
    return sessions.retained(table(spark, sf_dir, "events"), "event_type", "ts", now, 86400, 20).select("event_id")


@register("active_sessions", "WITH s AS (SELECT user_id, max(ts) + INTERVAL 1 HOUR AS expires FROM events GROUP BY user_id) SELECT user_id FROM s WHERE expires > TIMESTAMP '2024-01-29'")
def active_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg((F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("expires"))
    return rows.where("expires > TIMESTAMP_NTZ '2024-01-29'").select("user_id")


_FIRST = _SENT.format("context")


@register("query_batch", f"WITH {SCORED}, c AS (SELECT item_id, string_agg(text, chr(10) ORDER BY rank) AS context FROM b20 JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY item_id), f AS (SELECT text, min(item_id) AS item_id FROM benchmark GROUP BY text), a AS (SELECT f.text, coalesce({_FIRST}[1], 'No context.') AS answer FROM f LEFT JOIN c USING (item_id)) SELECT item_id, answer FROM benchmark JOIN a USING (text)")
def query_batch(spark, sf_dir):
    ranked = _bm25(spark, sf_dir, 3).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return services.answered(table(spark, sf_dir, "benchmark"), ranked, "item_id", "text", services.extractive)


@register("transcript_lines", "SELECT conv_id, string_agg('[' || printf('%02d:%02d', turn * 65 // 60, turn * 65 % 60) || ' - ' || printf('%02d:%02d', (turn * 65 + 60) // 60, (turn * 65 + 60) % 60) || '] ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcript_lines(spark, sf_dir):
    start = F.col("turn") * 65.0
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(start.alias("start"), (start + 60.0).alias("end"), "text"))).alias("segments"))
    return rows.select("conv_id", readers.segments_text("segments").alias("transcript"))


@register("event_follow_ups", """SELECT a.event_id AS first_id, b.event_id AS then_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def event_follow_ups(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    pairs = conversations.follow_ups(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"), "user_id", "event_id", "ts", "1 hour")
    return pairs.select("first_id", "then_id", "user_id")

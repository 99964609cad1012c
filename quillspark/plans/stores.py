"""Queries on versions, experiment logs and prompt usage kept as tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import stores
from quillspark.plans.registry import register
from quillspark.session import table

_V = "v AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)"


def _versions(spark, sf_dir):
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", number.alias("version_number"))


_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"


@register("version_compare", f"""WITH {_V}, c AS (SELECT a.conv_id, a.turn AS old_turn, b.turn AS new_turn, a.text AS o, b.text AS n, {_WORDS.format('a.text')} AS x, {_WORDS.format('b.text')} AS y FROM v a JOIN v b USING (conv_id) WHERE a.n = 1 AND b.n = 2),
k AS (SELECT *, len(list_intersect(list_distinct(x), list_distinct(y))) AS both_ FROM c)
SELECT conv_id, old_turn, new_turn, CAST(strlen(n) AS BIGINT) - strlen(o) AS bytes_added, o = n AS same, CAST(len(x) AS BIGINT) AS words_old, CAST(len(y) AS BIGINT) AS words_new,
CAST(len(list_distinct(y)) - both_ AS BIGINT) AS added, CAST(len(list_distinct(x)) - both_ AS BIGINT) AS removed, CAST(both_ AS BIGINT) AS common FROM k""")
def version_compare(spark, sf_dir):
    diff = ["words_old", "words_new", "added", "removed", "common"]
    return stores.compared(_versions(spark, sf_dir), "conv_id", 1, 2, "text").select("conv_id", "old_turn", "new_turn", "bytes_added", "same", *diff)


@register("version_export", f"WITH {_V} SELECT 'conv_id: ' || conv_id || chr(10) || 'turn: ' || turn || chr(10) || 'version_number: ' || n || chr(10) || chr(10) || coalesce(text, '') AS value FROM v")
def version_export(spark, sf_dir):
    return stores.exported(_versions(spark, sf_dir).select("conv_id", "turn", "version_number", "text"), "text", "text")


@register("version_newest", f"WITH {_V} SELECT conv_id, turn, text FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1")
def version_newest(spark, sf_dir):
    return stores.newest(_versions(spark, sf_dir), "conv_id", "version_number").select("conv_id", "turn", "text")


_LOG = "l AS (SELECT event_id, user_id, ['running', 'paused', 'completed'][event_id % 3 + 1] AS status, ts FROM events), p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'draft') AS previous FROM l)"


@register("experiment_transitions", f"WITH {_LOG} SELECT event_id, previous, (previous = 'draft' AND status = 'running') OR (previous = 'running' AND status IN ('paused', 'completed')) OR (previous = 'paused' AND status IN ('running', 'completed')) AS valid FROM p")
def experiment_transitions(spark, sf_dir):
    names = F.array(*map(F.lit, ["running", "paused", "completed"]))
    log = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.get(names, (F.col("event_id") % 3).cast("int")).alias("status"))
    return stores.transitions(log, "user_id", "status", "ts", "event_id").select("event_id", "previous", "valid")


@register("experiment_progress", "SELECT user_id, count(*) AS recorded, CASE WHEN count(*) >= 100 THEN 'completed' ELSE 'running' END AS status FROM events GROUP BY user_id")
def experiment_progress(spark, sf_dir):
    return stores.progress(table(spark, sf_dir, "events"), "user_id", 100)


@register("prompt_usage", "SELECT user_id, count(*) AS uses, round(avg(CASE WHEN value > 20 THEN 1.0::DOUBLE WHEN value <= 20 THEN 0.0 END), 6) AS success_rate, round(avg(value), 6) AS avg_score FROM events GROUP BY user_id ORDER BY uses DESC, user_id LIMIT 5")
def prompt_usage(spark, sf_dir):
    rows = stores.usage(table(spark, sf_dir, "events"), "user_id", F.col("value") > 20, F.col("value"))
    return rows.select("user_id", "uses", F.round("success_rate", 6).alias("success_rate"), F.round("avg_score", 6).alias("avg_score"))

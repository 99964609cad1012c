"""Experiments, feedback, versions, metrics, load tests and fine-tuning rows as relational analytics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import words

# --- experiments


def bucket(key: Column, n: int = 10_000) -> Column:
    """md5 as a 128-bit number modulo n, from four 32-bit pieces."""
    h = F.md5(key)
    part = lambda k: F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") % n
    return reduce(lambda a, b: a + b, [part(k) * (16 ** (8 * (3 - k)) % n) for k in range(4)]) % n


def assign(users: DataFrame, experiment: str, user: str, variants: list[tuple[str, float]]) -> DataFrame:
    """``users`` with bucket and variant: the first whose cumulative weight reaches the bucket's share, else the last."""
    share = F.col("bucket") / 10_000
    total, out = 0.0, None
    for name, weight in variants:
        total += weight
        out = F.when(share <= total, name) if out is None else out.when(share <= total, name)
    return users.withColumn("bucket", bucket(F.concat(F.lit(experiment + ":"), F.col(user).cast("string")))).withColumn("variant", out.otherwise(variants[-1][0]))


def variant_weights(variants: list[tuple[str, float]]) -> list[tuple[str, float]]:
    total = sum(w for _, w in variants)
    return [(n, w / total) for n, w in variants]


def variant_stats(results: DataFrame, variants: DataFrame, variant: str = "variant") -> DataFrame:
    """Count, success rate, mean and sample deviation of score and latency of each variant; one without results has zeros."""
    stats = results.groupBy(variant).agg(F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("score").alias("avg_score"), F.stddev_samp("score").alias("std_score"), F.avg("latency").alias("avg_latency"), F.stddev_samp("latency").alias("std_latency"))
    return variants.select(variant).distinct().join(stats, variant, "left").fillna(0)


def significance(stats: DataFrame, target: str = "avg_score", least: float = 0.05, variant: str = "variant") -> DataFrame:
    """One row: the best variant, its lead over the next one, whether the lead passes ``least``, and Welch's t of the two."""
    w = Window.orderBy(F.round(F.col(target), 6).desc(), F.col(variant))
    two = stats.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    one = two.agg(pick(1, variant).alias("best"), pick(1, target).alias("a"), pick(2, target).alias("b"), pick(1, "std_score").alias("sa"), pick(2, "std_score").alias("sb"), pick(1, "n").alias("na"), pick(2, "n").alias("nb"))
    err = F.sqrt(F.col("sa") * F.col("sa") / F.col("na") + F.col("sb") * F.col("sb") / F.col("nb"))
    return one.select("best", (F.col("a") - F.col("b")).alias("lead"), ((F.col("a") - F.col("b")) > least).alias("significant"), F.when(err > 0, (F.col("a") - F.col("b")) / err).otherwise(0.0).alias("welch_t"))


# --- feedback

RATINGS = {"very_bad": 1, "bad": 2, "neutral": 3, "good": 4, "very_good": 5}


def rating_value(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.create_map(*(F.lit(x) for kv in RATINGS.items() for x in kv))[col].cast("double")


def distributions(rows: DataFrame, *dimensions: str) -> DataFrame:
    """(dimension, level, n) of several columns in one pass over grouping sets."""
    sets = rows.groupingSets([[F.col(d)] for d in dimensions], *dimensions).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"))
    mark = {d: (1 << len(dimensions)) - 1 - (1 << (len(dimensions) - 1 - k)) for k, d in enumerate(dimensions)}
    name = reduce(lambda e, d: e.when(F.col("_g") == mark[d], d), dimensions[1:], F.when(F.col("_g") == mark[dimensions[0]], dimensions[0]))
    level = reduce(lambda e, d: e.when(F.col("_g") == mark[d], F.col(d).cast("string")), dimensions[1:], F.when(F.col("_g") == mark[dimensions[0]], F.col(dimensions[0]).cast("string")))
    return sets.select(name.alias("dimension"), level.alias("level"), "n")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows; numbers start at 1, sizes lie within 1 and 100."""
    number, size = max(1, number), min(100, max(1, size))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


# --- versions


def versions(rows: DataFrame, document: str, order: list[Column], content: str, version: str) -> DataFrame:
    """Version number, parent, sha256 and bytes of each version of a document."""
    w = Window.partitionBy(document).orderBy(*order)
    return rows.withColumns({"version_number": F.row_number().over(w).cast("long"), "parent": F.lag(version).over(w), "hash": F.sha2(F.col(content), 256), "size_bytes": F.octet_length(content).cast("long")})


def latest(rows: DataFrame, document: str, number: str = "version_number", keep: int = 1) -> DataFrame:
    """The newest ``keep`` versions of each document: the latest, or what retention keeps."""
    w = Window.partitionBy(document).orderBy(F.col(number).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def rollback(history: DataFrame, document: str, to: int, version: str = "version", number: str = "version_number") -> DataFrame:
    """``history`` and, for each document that has version ``to``, a new version with its content and it as parent."""
    top = history.groupBy(document).agg(F.max(number).alias("_top"))
    copy = history.where(F.col(number) == to).join(top, document).withColumns({"parent": F.col(version), number: F.col("_top") + 1}).drop("_top")
    return history.withColumn("action", F.lit("create")).unionByName(copy.withColumn("action", F.lit("restore")))


def word_diff(old: Column, new: Column) -> dict[str, Column]:
    a, b = words(old), words(new)
    return {"words_old": F.size(a).cast("long"), "words_new": F.size(b).cast("long"), "added": F.size(F.array_except(b, a)).cast("long"), "removed": F.size(F.array_except(a, b)).cast("long"), "common": F.size(F.array_intersect(a, b)).cast("long")}


def character_diff(old: Column, new: Column) -> dict[str, Column]:
    """Counts by position: a changed character is one removed and one added."""
    a, b = F.split(old, ""), F.split(new, "")
    na, nb = F.length(old), F.length(new)
    same = F.size(F.filter(F.zip_with(F.when(na == 0, F.array().cast("array<string>")).otherwise(a), F.when(nb == 0, F.array().cast("array<string>")).otherwise(b), lambda x, y: x == y), lambda e: F.coalesce(e, F.lit(False))))
    return {"added": (nb - same).cast("long"), "removed": (na - same).cast("long"), "unchanged": same.cast("long"), "change_percentage": (na + nb - 2 * same) / F.greatest(F.lit(1), na + nb) * 100}


def line_changes(old: list[str], new: list[str]) -> list[str]:
    """Greedy scan with one line of lookahead: lines with a blank, minus or plus in front."""
    out, i, j = [], 0, 0
    while i < len(old) and j < len(new):
        if old[i] == new[j]:
            out.append(" " + old[i])
            i, j = i + 1, j + 1
            continue
        out.append("-" + old[i])
        i += 1
        if i >= len(old) or old[i] != new[j]:
            out.append("+" + new[j])
            j += 1
    return out + ["-" + x for x in old[i:]] + ["+" + x for x in new[j:]]


def line_diff(pairs: DataFrame, id_col: str, old: str, new: str, shown: int = 100) -> DataFrame:
    """(id, added, removed, unchanged, change_percentage, diff): the first lines of the diff and its counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, a, b in zip(*(pdf[c] for c in pdf.columns), strict=True):
                a, b = (a or "").splitlines(), (b or "").splitlines()
                d = line_changes(a, b)
                n = {m: sum(x[0] == m for x in d) for m in "+- "}
                out.append((i, n["+"], n["-"], n[" "], len(d) / max(1, len(a) + len(b)) * 100, d[:shown]))
            yield pd.DataFrame(out, columns=[id_col, "added", "removed", "unchanged", "change_percentage", "diff"])

    return pairs.select(id_col, old, new).mapInPandas(run, f"`{id_col}` {pairs.schema[id_col].dataType.simpleString()}, added long, removed long, unchanged long, change_percentage double, diff array<string>")


# --- metrics


def index_percentiles(rows: DataFrame, by: str, value: str, ps: list[float]) -> DataFrame:
    """(by, n, p50, ..): the values at index int(n * p), without interpolation.

    Equal values are counted first, so a group sends one row for each distinct value.
    """
    counted = rows.groupBy(by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by)
    run = counted.withColumns({"_n": F.sum("_c").over(w), "_run": F.sum("_c").over(w.orderBy(value))})
    at = lambda p: F.min(F.when(F.col("_run") > F.floor(F.col("_n") * F.lit(p)), F.col(value)))
    return run.groupBy(by).agg(F.max("_n").alias("n"), *(at(p).alias(f"p{round(p * 100)}") for p in ps))


def metric_summary(rows: DataFrame, by: str, value: str, ts: str) -> DataFrame:
    """Count, sum, least, greatest, mean, last value and percentiles by index of each metric."""
    base = rows.groupBy(by).agg(F.sum(value).alias("sum"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.avg(value).alias("mean"), F.max_by(value, ts).alias("last_value"))
    return index_percentiles(rows, by, value, [0.5, 0.95, 0.99]).join(base, by)


def load_summary(rows: DataFrame, endpoint: str, value: str, ts: str, failed: Column) -> DataFrame:
    """Requests, success rate, mean, rate per second and p95 by index of each endpoint."""
    seconds = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6
    base = rows.groupBy(endpoint).agg(F.count("*").alias("requests"), F.avg(F.when(failed, 0.0).otherwise(1.0)).alias("success_rate"), F.avg(value).alias("mean"), (F.count("*") / F.greatest(seconds, F.lit(1e-9))).alias("per_second"))
    return base.join(index_percentiles(rows, endpoint, value, [0.95]).select(endpoint, "p95"), endpoint)


def prometheus_lines(rows: DataFrame, name: str, label: str, value: str, prefix: str = "quillspark") -> DataFrame:
    """Text exposition lines of a labelled counter."""
    return rows.select(F.format_string(f'{prefix}_{name}{{{label}="%s"}} %d', F.col(label).cast("string"), F.col(value)).alias("line"))


# --- fine-tuning


def qa_quality(question: Column, answer: Column, context: Column, category: Column) -> Column:
    """0.5 and additions for length, content, context and category, less 0.3 for placeholders, within 0 and 1."""
    q, a, c, k = (F.coalesce(x, F.lit("")) for x in (question, answer, context, category))
    add = lambda cond, by: F.when(cond, F.lit(by)).otherwise(0.0)
    s = F.lit(0.5) + add((F.length(q) > 10) & (F.length(a) > 20), 0.2) + add((F.trim(q) != "") & (F.trim(a) != ""), 0.1) + add(F.length(c) > 20, 0.1) + add(k != "", 0.05)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s - add(F.contains(a, F.lit("PLACEHOLDER")) | F.contains(a, F.lit("TODO")), 0.3)))


def augment(qa: DataFrame, factor: int = 2) -> DataFrame:
    """Rows and their variations: a leading What reworded, then a Please in front; a variation that changes nothing is left out."""
    q = F.col("question")
    kinds = [(q.startswith("What"), F.regexp_replace(q, "^What", "Could you explain what")), (~q.startswith("Please"), F.concat(F.lit("Please "), F.lower(F.substring(q, 1, 1)), q.substr(F.lit(2), F.length(q))))]
    out = qa.withColumn("variation", F.lit(0).cast("long"))
    for n, (cond, text) in enumerate(kinds[: max(0, factor - 1)]):
        out = out.unionByName(qa.where(cond).withColumns({"question": text, "variation": F.lit(n + 1).cast("long")}))
    return out


def split_by_hash(rows: DataFrame, key: Column, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """``rows`` with split by the md5 bucket of a key: the same row always falls in the same part, without a global sort."""
    share = bucket(key) / 10_000
    return rows.withColumn("split", F.when(share < train, "train").when(share < train + valid, "validation").otherwise("test"))


# System prompts of chat rows.
SYSTEM = "You are a helpful assistant that answers questions accurately and concisely."
SYSTEM_CONTEXT = "You are a helpful assistant that answers questions based on the provided context.\n\nContext: "


def _message(role: str, content: Column, keys: tuple[str, str] = ("role", "content")) -> Column:
    return F.struct(F.lit(role).alias(keys[0]), content.alias(keys[1]))


def chat_rows(qa: DataFrame, style: str) -> DataFrame:
    """``qa`` with row, one JSON or SQL line in the given style."""
    q, a, c = F.col("question"), F.col("answer"), F.coalesce(F.col("context"), F.lit(""))
    system = F.when(c != "", F.concat(F.lit(SYSTEM_CONTEXT), c)).otherwise(SYSTEM)
    asked = F.when(c != "", F.concat(F.lit("Context: "), c, F.lit("\n\nQuestion: "), q)).otherwise(q)
    inst = F.concat(F.lit("[INST] "), asked, F.lit(" [/INST] "), a)
    quote = lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    styles = {
        "openai": F.to_json(F.struct(F.array(_message("system", system), _message("user", q), _message("assistant", a)).alias("messages"))),
        "llama": F.to_json(F.struct(inst.alias("text"))),
        "mistral": F.to_json(F.struct(F.concat(F.lit("<s>"), inst, F.lit(" </s>")).alias("text"))),
        "sharegpt": F.to_json(F.struct(F.array(_message("system", system, ("from", "value")), _message("human", q, ("from", "value")), _message("gpt", a, ("from", "value"))).alias("conversations"))),
        "alpaca": F.to_json(F.struct(q.alias("instruction"), a.alias("output"), F.when(c != "", c).alias("input"))),
        "sql": F.concat(F.lit("INSERT INTO qa_pairs (question, answer) VALUES ("), quote(q), F.lit(", "), quote(a), F.lit(");")),
    }
    return qa.withColumn("row", styles[style])


def conversation_rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, row): all messages of a conversation in order, as one JSON line."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return turns.groupBy(conv).agg(F.to_json(F.struct(ordered.alias("messages"))).alias("row"))


def batch_summary(rows: DataFrame, status: str, ms: str) -> DataFrame:
    """Counts by outcome, success rate and mean time of a batch."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col(status) == "completed").alias("completed"), F.count_if(F.col(status) == "failed").alias("failed"), F.avg((F.col(status) == "completed").cast("double")).alias("success_rate"), F.avg(ms).alias("avg_ms"))


def retry_delay(attempt: int, base: float = 1.0, most: float = 60.0, exponent: float = 2.0, jitter: float = 1.0) -> float:
    """Seconds before a retry: exponential, capped, times a jitter within 0.8 and 1.2."""
    return min(most, base * exponent**attempt) * min(1.2, max(0.8, jitter))


def next_batch_size(now: int, tokens: float, seconds: float, target: int = 8000, least: int = 5, most: int = 100) -> int:
    """Adaptive batch size: a tenth of the way to target / tokens, a fifth less after a slow batch."""
    wanted = now * 0.8 if seconds > 5.0 else now + 0.1 * (target / max(1.0, tokens) - now)
    return int(min(most, max(least, wanted)))

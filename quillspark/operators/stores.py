"""Append-only stores: versions, prompts and experiment logs as tables, their latest views, exports and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import analytics


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a stored table; what is there is never rewritten."""
    rows.write.mode("append").option("compression", "zstd").parquet(path)


def newest(rows: DataFrame, key: str, *order: str, deleted: str | None = None) -> DataFrame:
    """The last row of each key by ``order``; a key whose last row is marked as deleted has none."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    last = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return last.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else last


def exported(versions: DataFrame, kind: str, content: str = "content") -> DataFrame:
    """(value): a line of JSON for each version, or its content behind its other columns as "name: value" lines."""
    if kind == "json":
        return versions.select(F.to_json(F.struct(*versions.columns)).alias("value"))
    if kind == "text":
        head = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in versions.columns if c != content]
        return versions.select(F.concat_ws("\n", *head, F.lit(""), F.coalesce(F.col(content), F.lit(""))).alias("value"))
    raise ValueError(f"unknown format {kind}")


def compared(history: DataFrame, document: str, old: int, new: int, content: str, number: str = "version_number") -> DataFrame:
    """Two numbered versions of each document that has both: bytes added, whether the contents are equal, and the counts of the word diff."""
    side = lambda n, p: history.where(F.col(number) == n).select(document, F.col(content).alias(f"_{p}"), *(F.col(c).alias(f"{p}_{c}") for c in history.columns if c not in (document, content, number)))
    both = side(old, "old").join(side(new, "new"), document)
    diff = analytics.word_diff(F.col("_old"), F.col("_new"))
    size = (F.octet_length("_new") - F.octet_length("_old")).cast("long").alias("bytes_added")
    return both.select("*", size, (F.col("_old") == F.col("_new")).alias("same"), *(c.alias(n) for n, c in diff.items())).drop("_old", "_new")


# --- experiments

# States an experiment may go to from each state.
NEXT = {"draft": ["running"], "running": ["paused", "completed", "cancelled"], "paused": ["running", "completed", "cancelled"], "completed": [], "cancelled": []}


def transitions(log: DataFrame, experiment: str, status: str, *order: str) -> DataFrame:
    """``log`` with previous (draft before the first entry) and valid: whether the step from there is allowed."""
    before = F.coalesce(F.lag(status).over(Window.partitionBy(experiment).orderBy(*order)), F.lit("draft"))
    steps = [F.lit(f"{a}>{b}") for a, many in NEXT.items() for b in many]
    return log.withColumn("previous", before).withColumn("valid", F.concat_ws(">", "previous", status).isin(steps))


def progress(results: DataFrame, experiment: str, sample_size: int) -> DataFrame:
    """(experiment, recorded, status): an experiment is completed once its sample is reached."""
    n = F.count("*")
    return results.groupBy(experiment).agg(n.alias("recorded"), F.when(n >= sample_size, "completed").otherwise("running").alias("status"))


# --- prompts


def usage(uses: DataFrame, prompt: str, success: Column, score: Column, most: int = 5) -> DataFrame:
    """(prompt, uses, success_rate, avg_score) of the ``most`` prompts used most; ties go to the smaller name."""
    stats = uses.groupBy(prompt).agg(F.count("*").alias("uses"), F.avg(success.cast("double")).alias("success_rate"), F.avg(score).alias("avg_score"))
    return stats.orderBy(F.col("uses").desc(), prompt).limit(most)


# --- manifests


def write_manifest(spark: SparkSession, path: str, **fields: str | int | float) -> None:
    """One JSON row of an index's or a benchmark run's parameters and counts."""
    spark.createDataFrame([tuple(fields.values())], list(fields)).coalesce(1).write.mode("overwrite").json(path)

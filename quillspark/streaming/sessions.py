"""Sessions, limits and alerts, for streams and for their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.streaming import conversations

MICROS = 1_000_000


def sessions(events: DataFrame, user: str, ts: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(user, start, end, n) of sessions that end after a gap; for streams and tables alike."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(ts, late)
    grouped = rows.groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return grouped.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def sessions_by_gaps(events: DataFrame, user: str, ts: str, seconds: int = 3600) -> DataFrame:
    """The same over a table with windows: a session starts where the event before is at least a gap away."""
    w = Window.partitionBy(user).orderBy(ts)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.when(t - F.lag(t).over(w) < seconds * MICROS, 0).otherwise(1)
    rows = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return rows.groupBy(user, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n"))


def last_messages(turns: DataFrame, conv: str, turn: str, most: int = 100) -> DataFrame:
    """The newest messages of each conversation, newest first by place."""
    w = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    return turns.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)


def window_counts(events: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """``events`` with in_window, the requests of a key in (now - seconds, now], and allowed; rejected ones count too."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(t).rangeBetween(-(seconds * MICROS - 1), 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("allowed", F.col("in_window") <= limit)


def decided(times: list[float], seen: list[float], blocked: float, most: int, seconds: float, block: float) -> tuple[list[bool], list[float], float]:
    """Decisions for ordered times given the allowed ones before; a full window blocks for ``block`` seconds if that is above 0."""
    out = []
    for t in times:
        if t < blocked:
            out.append(False)
            continue
        seen = [s for s in seen if s > t - seconds]
        if len(seen) < most:
            seen.append(t)
            out.append(True)
        else:
            blocked = t + block if block > 0 else blocked
            out.append(False)
    return out, seen, blocked


def limited(events: DataFrame, key: str, ts: str, id_col: str, most: int, seconds: float = 60.0, block: float = 0.0, late: str = "10 minutes") -> DataFrame:
    """(id, key, allowed): only allowed requests count towards the limit, so each decision depends on those before.

    Streams keep the allowed times of the window as state; tables are sorted by key and time and decided row by row, with the
    window of one key in memory. Streams drop what comes later than the watermark.
    """
    at = F.col(ts).cast("timestamp")
    rows = events.select(F.col(id_col).alias("id"), F.col(key).alias("key"), (F.unix_micros(at) / MICROS).alias("t"), at.alias("ts"))
    schema = f"id {events.schema[id_col].dataType.simpleString()}, key {events.schema[key].dataType.simpleString()}, allowed boolean"
    if events.isStreaming:
        return conversations.limited_stream(rows, schema, most, seconds, block, late)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen, blocked = None, [], 0.0
        for pdf in pdfs:
            out: list[bool] = []
            for name, times in pdf.groupby("key", sort=False, dropna=False)["t"]:
                if now is None or not (name == now[0] or (pd.isna(name) and pd.isna(now[0]))):
                    now, seen, blocked = (name,), [], 0.0
                some, seen, blocked = decided(times.tolist(), seen, blocked, most, seconds, block)
                out += some
            yield pdf.assign(allowed=out)[["id", "key", "allowed"]]

    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.drop("ts").repartition(parts, "key").sortWithinPartitions("key", "t", "id").mapInPandas(run, schema)


def alerts(events: DataFrame, ts: str, value: str, failed: Column, size: str = "5 minutes", p95_ms: float = 1000.0, error_ratio: float = 0.05) -> DataFrame:
    """(start, requests, p95, errors, slow, failing) of tumbling windows; the percentile is exact on tables and approximate on streams."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(ts, size)
    p95 = F.percentile_approx(value, 0.95, 10_000) if events.isStreaming else F.percentile(value, F.lit(0.95))
    grouped = rows.groupBy(F.window(ts, size).alias("w")).agg(F.count("*").alias("requests"), p95.alias("p95"), F.avg(failed.cast("double")).alias("errors"))
    return grouped.select(F.col("w.start").alias("start"), "requests", "p95", "errors", (F.col("p95") > p95_ms).alias("slow"), (F.col("errors") > error_ratio).alias("failing"))


def token_events(answers: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, seq, event, data, progress) of streamed answers: start, a token for each word, done; progress moves every ten tokens up to 0.9."""
    from quillspark.functions.text import words

    rows = answers.select(id_col, words(text).alias("_w"))
    n = F.size("_w")
    start = rows.select(id_col, F.lit(0).cast("long").alias("seq"), F.lit("start").alias("event"), F.lit("").alias("data"), F.lit(0.0).alias("progress"))
    tokens = rows.select(id_col, F.posexplode("_w").alias("p", "data")).select(id_col, (F.col("p") + 1).cast("long").alias("seq"), F.lit("token").alias("event"), "data", F.least(F.lit(0.9), 0.5 + F.floor((F.col("p") + 1) / 10) * 10 / 100.0 * 0.4).alias("progress"))
    done = rows.select(id_col, (n + 1).cast("long").alias("seq"), F.lit("done").alias("event"), F.lit("").alias("data"), F.lit(1.0).alias("progress"))
    return start.union(tokens).union(done)


def retained(points: DataFrame, key: str, ts: str, now: Column, seconds: int = 3600, most: int = 1000) -> DataFrame:
    """Points of the last ``seconds``, the newest ``most`` of each key."""
    recent = points.where(F.col(ts) >= now - F.expr(f"INTERVAL {seconds} SECONDS"))
    w = Window.partitionBy(key).orderBy(F.col(ts).desc())
    return recent.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def watch_folder(spark, folder: str, glob: str = "*", per_trigger: int = 100) -> DataFrame:
    """A stream of the files that arrive in a folder, as whole texts."""
    return spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(folder).withColumn("path", F.input_file_name())

"""Stateful streams: conversations and limiters with timers, duplicates and joins under a watermark, and counts of late rows.

State is kept by key in the state store and goes by timers on the watermark, so idle keys cost nothing. The store must be
RocksDB, which ``quillspark.session.build_session`` sets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


class _Idle:
    """A key's one timer: set anew by every batch of its rows."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle

    def reset(self, at_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)


class Conversation(StatefulProcessor):
    """History, settings and the running query of a session.

    A query starts an answer unless one is running or it has no text; an answer ends it, unless it was cancelled meanwhile; both enter the history, of which the
    newest ``most`` messages stay. Settings are merged by name. A session without messages for ``idle_seconds`` of event time ends: its state goes and an event says so.
    """

    def __init__(self, most: int, idle_seconds: int):
        self.most, self.idle_ms = most, idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "role string, text string")
        self.settings = handle.getMapState("settings", "name string", "value string")
        self.running = handle.getValueState("running", "query string, last_ms long")
        self.idle = _Idle(handle)

    def _state(self) -> tuple[str | None, int]:
        found = self.running.get() if self.running.exists() else None
        return (found[0], found[1]) if found else (None, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq")  # what one trigger brings for a session
        query, last = self._state()
        history = [tuple(r) for r in self.history.get()] if self.history.exists() else []
        out = []
        for seq, kind, text, ms in zip(pdf["seq"], pdf["kind"], pdf["text"], pdf["ms"], strict=True):
            text = "" if text is None else str(text)
            if last and int(ms) > last + self.idle_ms:
                # The trigger that would have ended the session brings its next message.
                out.append((key[0], None, "expired", "", len(history)))
                query, history = None, []
                self.settings.clear()
            last = max(last, int(ms))
            event, data = "error", f"unknown message type: {kind}"
            if kind == "query":
                if query is not None:
                    data = "already processing a query"
                elif not text:
                    data = "missing query"
                else:
                    query, event, data = text, "start", text
                    history.append(("user", text))
            elif kind == "answer":
                if query is None:
                    event, data = "dropped", "no query is running"
                else:
                    query, event, data = None, "done", text
                    history.append(("assistant", text))
            elif kind == "cancel":
                event, data = ("cancelled", query) if query is not None else ("error", "no query is running")
                query = None
            elif kind == "settings":
                event, data = self._merge(text)
            elif kind == "history":
                event, data = "history", json.dumps([list(m) for m in history[-self.most :]])
            elif kind == "clear":
                history, event, data = [], "cleared", ""
            elif kind == "ping":
                event, data = "pong", ""
            history = history[-self.most :]
            out.append((key[0], seq, event, data, len(history)))
        self.running.update((query, last))
        if history:
            self.history.put(history)
        else:
            self.history.clear()
        self.idle.reset(last + self.idle_ms)
        yield pd.DataFrame(out, columns=["session", "seq", "event", "data", "context_size"])

    def _merge(self, text: str) -> tuple[str, str]:
        try:
            new = json.loads(text)
            if not isinstance(new, dict):
                raise ValueError
        except ValueError:
            return "error", "settings are no JSON object"
        for name, value in new.items():
            self.settings.updateValue((name,), (json.dumps(value),))
        held = {k[0]: json.loads(v[0]) for k, v in self.settings.iterator()}
        return "settings_updated", json.dumps(held, sort_keys=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        size = len(list(self.history.get())) if self.history.exists() else 0
        for state in (self.history, self.settings, self.running):
            state.clear()
        yield pd.DataFrame([(key[0], None, "expired", "", size)], columns=["session", "seq", "event", "data", "context_size"])

    def close(self) -> None:
        pass


def conversations(messages: DataFrame, session: str, kind: str, text: str, seq: str, ts: str, most: int = 10, idle_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(session, seq, event, data, context_size) of a stream of messages: query, answer, cancel, settings (a JSON object), history, clear and ping; others are errors."""
    rows = messages.select(F.col(session).alias("session"), F.col(seq).alias("seq"), F.col(kind).alias("kind"), F.col(text).alias("text"), F.col(ts).cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    schema = StructType.fromDDL(f"session {messages.schema[session].dataType.simpleString()}, seq {messages.schema[seq].dataType.simpleString()}, event string, data string, context_size long")
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=Conversation(most, idle_seconds), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class Limiter(StatefulProcessor):
    """Times of the allowed requests of a key, and until when it is blocked; both go when they can no longer count."""

    def __init__(self, most: int, seconds: float, block: float):
        self.most, self.seconds, self.block = most, seconds, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "seen array<double>, blocked double")
        self.idle = _Idle(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        from quillspark.streaming.sessions import decided

        found = self.state.get() if self.state.exists() else None
        seen, blocked = (list(found[0]), found[1]) if found else ([], 0.0)
        pdf = pd.concat(list(rows)).sort_values(["t", "id"])
        out, seen, blocked = decided(pdf["t"].tolist(), seen, blocked, self.most, self.seconds, self.block)
        self.state.update((seen, blocked))
        self.idle.reset(int(1000 * max(blocked, max(seen, default=0.0) + self.seconds)) + 1)
        yield pdf.assign(allowed=out, key=key[0])[["id", "key", "allowed"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited_stream(rows: DataFrame, schema: str, most: int, seconds: float, block: float, late: str) -> DataFrame:
    """(id, key, allowed) of a stream (id, key, t in seconds, ts); see ``sessions.limited``."""
    marked = rows.withWatermark("ts", late)
    return marked.groupBy("key").transformWithStateInPandas(statefulProcessor=Limiter(most, seconds, block), outputStructType=StructType.fromDDL(schema), outputMode="Append", timeMode="EventTime")


def first_seen(events: DataFrame, keys: list[str], ts: str, within: str = "1 hour") -> DataFrame:
    """Events without those whose keys came within the time before: a stream forgets a key when the watermark has passed it by ``within``."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def follow_ups(first: DataFrame, then: DataFrame, key: str, id_col: str, ts: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(first_id, then_id, key, first_ts, then_ts): pairs of events of a key of which the second comes within a time after the first.

    For streams and tables alike; streams keep each side's events only as long as a partner can still come.
    """
    sides = []
    for df, name in ((first, "first"), (then, "then")):
        rows = df.select(F.col(key).alias(f"{name}_key"), F.col(id_col).alias(f"{name}_id"), F.col(ts).cast("timestamp").alias(f"{name}_ts"))
        sides.append(rows.withWatermark(f"{name}_ts", late) if df.isStreaming else rows)
    near = (F.col("first_key") == F.col("then_key")) & (F.col("then_ts") > F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return sides[0].join(sides[1], near).select("first_id", "then_id", F.col("first_key").alias(key), "first_ts", "then_ts")


def window_totals(events: DataFrame, ts: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, n) of tumbling windows; a stream closes a window when the watermark passes its end, and drops rows of closed ones."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, size).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def late_rows(query) -> int:
    """Rows that a stream's stateful operators have dropped as later than the watermark, as far as its progress reaches back."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

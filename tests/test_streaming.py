"""Streams give the rows of their batch twins."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import conversations, sessions

SF = "/root/testdata/sf0.001"


def drain(spark, df, mode, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name).collect()


@pytest.fixture
def stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), events


def test_sessions(spark, stream, tmp_path):
    live, events = stream
    got = {tuple(r) for r in drain(spark, sessions.sessions(live, "user_id", "ts"), "complete", tmp_path, "sessions_out")}
    assert got == {tuple(r) for r in sessions.sessions(events, "user_id", "ts").collect()}
    twin = sessions.sessions_by_gaps(events, "user_id", "ts")
    assert sorted((r.user_id, r.start, r.n) for r in twin.collect()) == sorted((u, s, n) for u, s, _, n in got)


def test_limits(spark, stream, tmp_path):
    live, events = stream
    got = {tuple(r) for r in drain(spark, sessions.limited(live, "user_id", "ts", "event_id", 2, 3600.0, 7200.0), "append", tmp_path, "limits_out")}
    assert got == {tuple(r) for r in sessions.limited(events, "user_id", "ts", "event_id", 2, 3600.0, 7200.0).collect()}


def test_limiter_depends_on_earlier_decisions():
    assert sessions.decided([0, 1, 2, 61.5], [], 0.0, 2, 60.0, 0.0)[0] == [True, True, False, True]
    assert sessions.decided([0, 1, 2, 61.5, 400], [], 0.0, 2, 60.0, 300.0)[0] == [True, True, False, False, True]


def test_alerts(spark, stream, tmp_path):
    live, events = stream
    bad = F.col("event_type") == "error"
    got = {(r.start, r.requests, round(r.errors, 9)) for r in drain(spark, sessions.alerts(live, "ts", "value", bad, "1 hour"), "complete", tmp_path, "alerts_out")}
    assert got == {(r.start, r.requests, round(r.errors, 9)) for r in sessions.alerts(events, "ts", "value", bad, "1 hour").collect()}


def batches(spark, folder, schema, *parts):
    """A stream that brings each part in a trigger of its own."""
    folder.mkdir(parents=True)
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}-{k}")
        part = next(p for p in (folder.parent / f"{folder.name}-{k}").glob("part-*"))
        part.rename(folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_conversations_keep_state_over_triggers_and_expire(spark, tmp_path):
    schema = "session string, seq long, kind string, text string, ts timestamp"
    live = batches(
        spark, tmp_path / "in", schema,
        [("a", 1, "query", "x", at(0)), ("a", 2, "query", "again", at(1)), ("a", 3, "ping", "", at(1)), ("b", 1, "query", None, at(1)), ("b", 2, "settings", '{"k": 3}', at(2)), ("b", 3, "odd", "", at(2))],
        [("a", 4, "answer", "y", at(3)), ("a", 5, "query", "z", at(4)), ("b", 4, "settings", '{"top": 1, "k": 5}', at(4)), ("b", 5, "settings", "no json", at(4))],
        [("a", 6, "cancel", "", at(5)), ("a", 7, "answer", "late", at(6)), ("a", 8, "history", "", at(6)), ("a", 9, "cancel", "", at(6))],
        [("c", 1, "ping", "", at(300))],
        [("a", 10, "history", "", at(301)), ("b", 6, "settings", "{}", at(301)), ("c", 2, "clear", "", at(301))],
    )
    rows = drain(spark, conversations.conversations(live, "session", "kind", "text", "seq", "ts", most=3, idle_seconds=3600), "append", tmp_path, "conv_out")
    got = {(r.session, r.seq): (r.event, r.data, r.context_size) for r in rows}
    assert len(got) == len(rows) == 20
    assert [got["a", k][:2] for k in (1, 2, 3, 4, 5)] == [("start", "x"), ("error", "already processing a query"), ("pong", ""), ("done", "y"), ("start", "z")]
    assert got["a", 6] == ("cancelled", "z", 3) and got["a", 7][0] == "dropped" and got["a", 9][0] == "error"
    assert got["a", 8] == ("history", '[["user", "x"], ["assistant", "y"], ["user", "z"]]', 3)
    assert got["b", 1][:2] == ("error", "missing query") and got["b", 3][0] == "error" and got["b", 5][0] == "error"
    assert got["b", 2][:2] == ("settings_updated", '{"k": 3}') and got["b", 4][1] == '{"k": 5, "top": 1}'
    # The idle sessions have ended; what they get later starts anew.
    assert got["a", None] == ("expired", "", 3) and got["b", None] == ("expired", "", 0)
    assert got["a", 10] == ("history", "[]", 0) and got["b", 6][1] == "{}" and got["c", 2][0] == "cleared"


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    schema = "id long, ts timestamp"
    live = batches(spark, tmp_path / "in", schema, [(1, at(0)), (2, at(5))], [(3, at(200))], [(8, at(202))], [(4, at(10)), (5, at(201)), (6, at(195))], [(7, at(500))])
    query = conversations.window_totals(live, "ts").writeStream.format("memory").queryName("late_out").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/late").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.start.replace(tzinfo=timezone.utc): r.n for r in spark.sql("SELECT CAST(start AS TIMESTAMP_NTZ) AS start, n FROM late_out").collect()}
    assert got == {at(0): 2, at(180): 4}
    assert conversations.late_rows(query) == 1


def test_duplicates_within_the_watermark(spark, tmp_path):
    schema = "key string, n long, ts timestamp"
    live = batches(spark, tmp_path / "in", schema, [("a", 1, at(0)), ("a", 2, at(1)), ("b", 1, at(2))], [("a", 3, at(30)), ("c", 1, at(200))], [("e", 1, at(201))], [("a", 4, at(190)), ("c", 2, at(201))], [("d", 1, at(202))])
    got = sorted((r.key, r.n) for r in drain(spark, conversations.first_seen(live, ["key"], "ts", "1 hour"), "append", tmp_path, "dup_out"))
    assert [k for k, _ in got] == ["a", "a", "b", "c", "d", "e"] and ("a", 3) not in got and ("c", 2) not in got and ("a", 4) in got
    table = spark.createDataFrame([("a", 1, at(0)), ("a", 2, at(1)), ("b", 1, at(2))], schema)
    assert conversations.first_seen(table, ["key"], "ts").count() == 2


def test_follow_ups_of_a_stream_are_those_of_the_table(spark, tmp_path):
    schema = "id long, user long, kind string, ts timestamp"
    parts = [[(1, 1, "view", at(0)), (2, 1, "buy", at(30)), (3, 2, "buy", at(5))], [(4, 1, "buy", at(61)), (5, 2, "view", at(6)), (6, 2, "buy", at(66)), (7, 1, "view", at(60))], [(8, 1, "buy", at(120)), (9, 3, "view", at(119))]]
    live = batches(spark, tmp_path / "in", schema, *parts)
    table = spark.createDataFrame([r for p in parts for r in p], schema)
    pairs = lambda df: conversations.follow_ups(df.where("kind = 'view'"), df.where("kind = 'buy'"), "user", "id", "ts", "1 hour", "3 hours").select("first_id", "then_id")
    want = {tuple(r) for r in pairs(table).collect()}
    assert want == {(1, 2), (7, 4), (5, 6), (7, 8)}
    assert {tuple(r) for r in drain(spark, pairs(live), "append", tmp_path, "join_out")} == want


def test_limits_over_triggers_and_idle_keys(spark, tmp_path):
    schema = "event_id long, user_id string, ts timestamp"
    parts = [[(1, "a", at(0)), (2, "a", at(1)), (3, "a", at(2)), (4, "b", at(2))], [(5, "a", at(3)), (6, "b", at(4)), (7, None, at(4))], [(8, "a", at(200)), (9, None, at(200)), (10, "a", at(201)), (11, "a", at(202))]]
    live = batches(spark, tmp_path / "in", schema, *parts)
    options = ("user_id", "ts", "event_id", 2, 600.0, 900.0)
    got = {tuple(r) for r in drain(spark, sessions.limited(live, *options), "append", tmp_path, "limit_out")}
    assert got == {tuple(r) for r in sessions.limited(spark.createDataFrame([r for p in parts for r in p], schema), *options).collect()}
    assert {i for i, _, ok in got if not ok} == {3, 5, 11}


def test_watched_folder(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("one\ntwo")
    rows = drain(spark, sessions.watch_folder(spark, f"file://{tmp_path}/docs", "*.txt"), "append", tmp_path, "watch_out")
    assert [r.value for r in rows] == ["one\ntwo"]

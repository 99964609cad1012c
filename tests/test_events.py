"""The event sink writes each event once, whatever is run again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.sources import events

SCHEMA = "id long, event string, text string"


def put(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}-{number}")
    folder.mkdir(exist_ok=True)
    part = next((folder.parent / f"{folder.name}-{number}").glob("part-*"))
    part.rename(folder / f"{number}.parquet")
    os.utime(folder / f"{number}.parquet", (1_700_000_000 + number, 1_700_000_000 + number))


def run(spark, tmp_path, **options):
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("n", F.length("text"))
    writer = live.writeStream.format(events.FORMAT).option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").options(**options)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_events_are_written_once_over_restarts(spark, tmp_path):
    events.register(spark)
    put(spark, tmp_path / "in", 0, [(1, "start", "a"), (2, "token", "é\n")])
    put(spark, tmp_path / "in", 1, [(3, "token", None)])
    run(spark, tmp_path)
    out = f"file://{tmp_path}/out"
    read = lambda: sorted(tuple(r) for r in events.read_events(spark, out, "id long, event string, text string, n long").collect())
    first = [(1, "start", "a", 1), (2, "token", "é\n", 2), (3, "token", None, None)]
    assert read() == first and len(events.committed_files(out)) == 2
    # The last trigger runs again, as after a crash between the sink's commit and Spark's own; then new rows come.
    for name in ("1", ".1.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    put(spark, tmp_path / "in", 2, [(4, "done", "z")])
    run(spark, tmp_path)
    assert read() == [*first, (4, "done", "z", 1)]
    assert len(events.committed_files(out)) == 3 == len(list((tmp_path / "out" / "data").iterdir()))
    # A file that no commit lists does not count.
    (tmp_path / "out" / "data" / "stray.ndjson").write_text('{"id": 99}\n')
    assert len(read()) == 4


def test_frames(spark, tmp_path):
    events.register(spark)
    put(spark, tmp_path / "in", 0, [(7, "token", "x")])
    run(spark, tmp_path, kind="sse", retry="50")
    text = open(events.committed_files(f"file://{tmp_path}/out")[0].removeprefix("file://")).read()
    assert text == 'event: token\nid: 7\nretry: 50\ndata: {"text": "x", "n": 1}\n\n'
    assert json.loads(events.frame({"id": 1, "event": None}, "ndjson", 1)) == {"id": 1, "event": None}
    assert events.frame({"id": None, "x": 1}, "sse", 5) == 'retry: 5\ndata: {"x": 1}\n\n'
    with pytest.raises(ValueError):
        events.EventWriter("/x", "odd", 1)


def test_empty_output(spark, tmp_path):
    assert events.read_events(spark, f"file://{tmp_path}/none", "id long").count() == 0

"""Question-answer sets and fine-tuning files."""

import json
import sqlite3

from pyspark.sql import functions as F

from quillspark.sources import datasets


def test_sets_of_every_format(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("a.json", json.dumps([{"question": "q1", "answer": "a1", "metadata": {"k": 1}}, {"question": "", "answer": "x"}, {"messages": []}]))
    put("b.json", json.dumps({"version": 2, "samples": [{"question": "q2", "answer": "a2", "context": "c"}]}))
    put("c.jsonl", '{"query": "q3", "reference": "a3"}\nno json\n\n{"question": "q4", "answer": "a4", "query": "other"}\n')
    put("d.csv", 'question,answer,category\nq5,"a5\nwith a line",k\nq6,,k\n')
    put("e.json", json.dumps({"data": [{"title": "t", "paragraphs": [{"context": "ctx", "qas": [{"question": "q7", "answers": [{"text": "a7"}, {"text": "b7"}]}, {"question": "q8", "answers": []}]}]}]}))
    put("skipped.txt", "question")
    rows = {r.question: r for r in datasets.qa_set(spark, str(tmp_path)).collect()}
    assert set(rows) == {"q1", "q2", "q3", "q4", "q5", "q7"}
    assert json.loads(rows["q1"].metadata) == {"k": 1} and rows["q2"].context == "c" and rows["q3"].answer == "a3" and rows["q4"].answer == "a4"
    assert rows["q5"].answer == "a5\nwith a line" and rows["q5"].category == "k" and (rows["q7"].answer, rows["q7"].context) == ("a7", "ctx")
    put("f.csv", "Frage;Antwort;Text\nq9;a9;t9\nq10;a10;t10\n")
    named = datasets.qa_set(spark, str(tmp_path / "f.csv"), "Frage", "Antwort", "Text")
    assert [(r.question, r.answer, r.context) for r in named.orderBy("question").collect()] == [("q10", "a10", "t10"), ("q9", "a9", "t9")]
    (tmp_path / "none").mkdir()
    assert datasets.qa_set(spark, str(tmp_path / "none")).columns == datasets.FIELDS


def test_conversation_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "1", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}\n{"question": "q"}\n')
    assert [tuple(r) for r in datasets.conversations(spark, str(tmp_path / "c.jsonl")).collect()] == [("1", 0, "user", "hi"), ("1", 1, "assistant", "yo")]


def test_written_sets(spark, tmp_path):
    rows = [(None, f"What is number {k}, it's?", f"The answer to number {k} is {k}.", "c" if k % 2 else None, None, None, None, None) for k in range(300)]
    qa = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in datasets.FIELDS))
    out = str(tmp_path / "out")
    meta = {r.split: r for r in datasets.write_sets(qa, out, ["openai", "alpaca", "sql"]).collect()}
    assert sum(r.n for r in meta.values()) == 300 and 200 < meta["train"].n < 270 and meta["test"].styles == "openai,alpaca,sql"
    questions = {}
    for style in ("openai", "alpaca", "sql"):
        text = spark.read.text(f"{out}/{style}")
        assert {r.split: r["count"] for r in text.groupBy("split").count().collect()} == {s: r.n for s, r in meta.items()}
        found = text.withColumn("q", F.regexp_extract("value", r"number (\d+)", 1)).select("q", "split").collect()
        questions[style] = {(r.q, r.split) for r in found}
    assert questions["openai"] == questions["alpaca"] == questions["sql"] and len(questions["sql"]) == 300
    con = sqlite3.connect(":memory:")
    con.execute(datasets.SQL_TABLE)
    for r in spark.read.text(f"{out}/sql").collect():
        con.execute(r.value)
    assert con.execute("SELECT count(*), count(context), count(DISTINCT id) FROM fine_tune_data").fetchone() == (300, 150, 300)
    assert con.execute("SELECT question FROM fine_tune_data WHERE answer LIKE '% is 7.'").fetchone() == ("What is number 7, it's?",)

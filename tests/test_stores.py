import pytest

from quillspark.operators import prompts, stores
from quillspark.sources import readers


def test_append_newest_and_deleted(spark, tmp_path):
    path = str(tmp_path / "prompts")
    for n, (text, gone) in enumerate([("a", False), ("b", False), ("c", True)]):
        stores.append(spark.createDataFrame([("p", n, text, gone), ("q", n, text, False)], "name string, version int, text string, deleted boolean"), path)
    rows = spark.read.parquet(path)
    assert rows.count() == 6
    assert [(r.name, r.text) for r in stores.newest(rows, "name", "version", deleted="deleted").collect()] == [("q", "c")]


def test_export_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", None), (2, "y", "text")], "id int, author string, content string")
    assert [r.value for r in stores.exported(rows, "text").orderBy("value").collect()] == ["id: 1\nauthor: x\n\n", "id: 2\nauthor: y\n\ntext"]
    assert stores.exported(rows, "json").count() == 2
    with pytest.raises(ValueError):
        stores.exported(rows, "pdf")
    stores.write_manifest(spark, str(tmp_path / "m"), model="hash", n=3)
    assert spark.read.json(str(tmp_path / "m")).first().asDict() == {"model": "hash", "n": 3}


def test_compare_and_transitions(spark):
    rows = spark.createDataFrame([("d", 1, "one two"), ("d", 2, "one three four"), ("e", 1, "x")], "doc string, version_number int, content string")
    (r,) = stores.compared(rows, "doc", 1, 2, "content").collect()
    assert (r.doc, r.bytes_added, r.same, r.added, r.removed) == ("d", 7, False, 2, 1)
    log = spark.createDataFrame([("e", 1, "running"), ("e", 2, "completed"), ("e", 3, "running")], "e string, at int, status string")
    assert [r.valid for r in stores.transitions(log, "e", "status", "at").orderBy("at").collect()] == [True, True, False]


def test_sanitised_html():
    clean = lambda h: readers.sanitized(h, readers.ALLOWED_TAGS)
    assert clean('<p onclick="x()" class="c">a<div>b</div></p><script>evil()</script>') == '<p class="c">ab</p>'
    assert clean('<a href="java\tscript:x()">a</a><a href="/p:q">b</a><a href="https://h/">c</a>') == '<a>a</a><a href="/p:q">b</a><a href="https://h/">c</a>'
    assert clean("a &lt; b &#38; c <br/>") == "a &lt; b &#38; c <br>"


def test_main_role_and_unclosed_elements():
    assert readers.walk('<div>menu</div><div role="main"><p>text</p></div><p>end</p>')[0] == "text"
    assert readers.walk("<div><form><p>gone</div><p>kept</p>")[0] == "kept"
    assert readers.walk("</div><p>one<nav><ul><li>x</ul></nav>two</p>")[0] == "one\n\ntwo"


def test_csv_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name;age\n caf\u00e9 ;3\nx;14\ny;20\n".encode("latin-1"))
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["name", "age", "_malformed"]
    assert [tuple(r) for r in rows.collect()] == [("caf\u00e9", "3", None), ("x", "14", None), ("y", "20", None)]


def test_dated_models_have_their_own_price(spark):
    rows = spark.createDataFrame([("gpt-4o-2024-08-06", 1000, 1000), ("gpt-4", 1000, 1000)], "m string, p long, c long")
    assert [round(r.cost, 6) for r in prompts.with_cost(rows, "m", "p", "c").collect()] == [0.0125, 0.09]

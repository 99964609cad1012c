"""CSV scans, page metadata and main content."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import readers


def test_encoding_is_told_from_the_whole_file(spark, tmp_path):
    lines = ["name;n", *(f"plain{k};{k}" for k in range(400)), "caf\u00e9;400"]
    (tmp_path / "latin.csv").write_bytes("\n".join(lines).encode("latin-1"))
    (tmp_path / "utf8.csv").write_bytes("\n".join(lines).encode())
    for name in ("latin", "utf8"):
        rows = readers.read_csv(spark, str(tmp_path / f"{name}.csv")).collect()
        assert len(rows) == 401 and rows[400].name == "caf\u00e9"
    both = readers.read_csv(spark, str(tmp_path)).where("name = 'caf\u00e9'")
    assert both.count() == 2


def test_quoted_line_breaks_stay_in_their_row(spark, tmp_path):
    text = 'id,text\n1,"two\nlines, and ""quotes"""\n2,"three\n\nlines"\n3,plain\n'
    (tmp_path / "a.csv").write_text(text)
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in rows.collect()] == [("1", 'two\nlines, and "quotes"', None), ("2", "three\n\nlines", None), ("3", "plain", None)]


def test_malformed_rows_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,n\n1,a,5\n2,b\n3,c,7,extra\n4,d,8\n")
    rows = {r.id: r for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert rows["1"]._malformed is None and rows["4"].n == "8"
    assert rows["2"].n is None and rows["2"]._malformed == "2,b"
    assert rows["3"].n == "7" and rows["3"]._malformed == "3,c,7,extra"


def test_delimiter_of_a_table_with_long_texts(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("id;text\n1;many words of text, and commas, and more\n2;other words without a comma at all\n")
    rows = readers.read_csv(spark, str(tmp_path / "a b.csv"))
    assert rows.columns[:2] == ["id", "text"] and rows.count() == 2
    (tmp_path / "empty.csv").write_text("")
    assert readers.read_csv(spark, str(tmp_path / "empty.csv")).count() == 0


def test_export_and_scan_keep_values(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, "x\ny"), (3, "l\u00edne;tab\t.")], "id long, text string")
    readers.export(df, str(tmp_path / "out"), "csv")
    assert sorted((int(r.id), r.text, r._malformed) for r in readers.read_csv(spark, str(tmp_path / "out")).collect()) == [(r.id, r.text, None) for r in df.collect()]


PAGE = """<html><head><title> A &amp; B
 title </title><meta charset="utf-8"><meta name="Description" content="first"><META NAME='description' CONTENT='a > b'><meta name=keywords content="x, y ,,z">
<meta name="author" content="Me"><meta name="robots" content="noindex"><meta property="og:title" content="OG &quot;t&quot;"><meta property="og:image" content="http://i"><meta name="empty" content="">
<!-- <meta name="author" content="hidden"> --><script>var x = '<meta name="robots" content="no"><a href="http://no.org">';</script>
<script type="application/ld+json">{"@type": "Article", "n": [1, 2]}</script><script type='application/ld+json'>not json</script></head>
<body><h1>One <b>bold</b></h1><h2>Two</h2><h2 class="x">Three</h2><a href="https://b.org/x">b</a><a href='//a.org'>a</a><a name="n">none</a><a href="/local">l</a><img src=1 alt="yes"><img src=2 alt=""><img src=3></body></html>"""


def test_page_metadata(spark):
    pages = spark.createDataFrame([(1, PAGE, "t"), (2, None, "t"), (3, "<p>bare", "t")], "page_id long, html string, title string")
    rows = {r.page_id: r for r in readers.html_metadata(pages, "page_id", "html").withColumn("json", F.transform("json_ld", lambda j: F.to_json(j))).withColumn("kind", F.transform("json_ld", lambda j: F.variant_get(j, "$['@type']", "string"))).drop("json_ld").collect()}
    r = rows[1]
    assert (r.title, r.description, r.author, r.robots, r.keywords) == ("A & B title", "a > b", "Me", "noindex", ["x", "y", "z"])
    assert r.meta == {"description": "a > b", "keywords": "x, y ,,z", "author": "Me", "robots": "noindex", "og:title": 'OG "t"', "og:image": "http://i"}
    assert r.open_graph == {"og:title": 'OG "t"', "og:image": "http://i"}
    assert [json.loads(j) for j in r.json] == [{"@type": "Article", "n": [1, 2]}] and r.kind == ["Article"]
    assert r.headings == {"h1": ["One bold"], "h2": ["Two", "Three"]}
    assert (r.total_links, r.linked_domains, r.total_images, r.images_with_alt) == (4, ["a.org", "b.org"], 3, 1)
    for k in (2, 3):
        r = rows[k]
        assert (r.title, r.description, r.keywords, r.meta, r.open_graph, r.json, r.headings, r.total_links, r.linked_domains) == (None, None, [], {}, {}, [], {}, 0, [])
    assert readers.html_metadata(pages.limit(0), "page_id", "html").count() == 0


MARKED = ["<main>{}</main>", "<article>{}</article>", '<div role="main">{}</div>', '<div class="x main-content">{}</div>', '<section id="main-content">{}</section>', '<p class="content">{}</p>', '<div id="content">{}</div>', '<div class="post-content">{}</div>', '<span class="article-content">{}</span>']


@pytest.mark.parametrize("k", range(len(MARKED)))
def test_main_content_is_that_of_the_surest_selector(k):
    later = "".join(m.format(f"later{n}") for n, m in enumerate(MARKED) if n > k)
    page = f"<body><div>menu</div>{later}{MARKED[k].format('wanted')}{MARKED[k].format('second')}<p>end</p></body>"
    assert readers.walk(page)[0] == "wanted"


def test_main_content_nested_hidden_and_missing():
    assert readers.walk('<div class="content">a<main>b<article>c</article></main>d</div>')[0] == "b\n\nc"
    assert readers.walk('<nav><main>menu</main></nav><div class="content-wide">x</div><div id="content">y</div>')[0] == "y"
    assert readers.walk("<p>one</p><div role='navigation'>two</div>")[0] == "one\n\ntwo"
    assert readers.walk("<main></main><p>other</p>")[0] == ""

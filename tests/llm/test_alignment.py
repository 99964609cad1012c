"""Cross-tokenizer alignment against a brute-force version, document by document."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillspark.llm import alignment, tokens

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("w", StringType())])


def brute(rows):
    both = alignment.Sides(tokens.default_path(), tokens.default_path("piece_bpe_32k.model"))
    docs, counts = [], Counter()
    for i, text in rows:
        whole = " " + (text or "")
        a, b = (both.a.encode(whole), both.b.encode(text)) if text else ([], [])
        x, y = [both.a_bytes[t] for t in a], [both.b_bytes[t] for t in b]
        if not text or b"".join(x) != whole.encode() or b"".join(y) != whole.encode():
            docs.append((i, [], [], [], []))
            continue
        ends = [list(accumulate(map(len, part))) for part in (x, y)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links, p = [], 0
        for s, e, t in zip([0, *ends[0]], ends[0], a, strict=False):
            p = max(0, p - 1)
            while p < len(b) and ends[1][p] - len(y[p]) < e:
                if ends[1][p] > s:
                    links.append((t, b[p]))
                p += 1
        groups = [([], []) for _ in cuts]
        for side, ids, own in ((0, a, ends[0]), (1, b, ends[1])):
            at = 0
            for t, e in zip(ids, own, strict=True):
                while e > cuts[at]:
                    at += 1
                groups[at][side].append(t)
        counts.update(set(links))
        docs.append((i, a, b, groups, links))
    best = defaultdict(int)
    for (t, _), n in counts.items():
        best[t] = max(best[t], n)
    for i, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        yield i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest


def check(spark, rows, **options):
    out = alignment.align(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), **options)
    assert out.columns == ["doc_id", *alignment.SUMS, "groups_sha256"]
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute(rows), key=key)


ODD = [None, "", " ", "\n", "  two  blanks\n\nand lines \n at end  ", "don't\tstop\r\nhere", "a▁b", "x <|endoftext|> y <s> </s> <unk> <0x41>", "naïve café œuvre ÿ", "日本語 テキスト 东京 2024", "emoji 😀 flag 🇫🇷 zero​width soft­hyphen", " nbsp  em　wide", "tab\t\tend\x00nul \x1c sep", "1234567890 3.14159 0xdeadbeef", "é é ́lone", "end with blank ", "\nstart", "same same same", "same same same"]


def test_odd_texts(spark):
    check(spark, [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (3, "repeated id")])


def test_documents_of_a_table_in_small_shards(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, shard_bytes=50_000)


def test_long_text_without_cuts_and_many_stretches(spark):
    check(spark, [(1, "é" * 5_000 + "x" * 20_000), (2, "ab " * 30_000), (3, "ab ab")])


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", [t for t in ODD if t])
def test_stretches_are_encoded_as_the_whole(text):
    both = alignment.Sides(tokens.default_path(), tokens.default_path("piece_bpe_32k.model"))
    a, b = both.encode(both.stretches(text))
    assert sum(a, []) == both.a.encode(" " + text) and sum(b, []) == both.b.encode(text)

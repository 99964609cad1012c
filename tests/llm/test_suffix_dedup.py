import hashlib
import random
from collections import Counter

import pytest
from tests.llm.fixtures import SCHEMA, TEXTS, documents, empty

from quillspark.llm import suffix_dedup

LENGTH = 200


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + LENGTH] for d in data for p in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        cover = [False] * len(d)
        for p in range(len(d) - LENGTH + 1):
            if seen[d[p : p + LENGTH]] > 1:
                cover[p : p + LENGTH] = [True] * LENGTH
        kept = bytes(b for b, c in zip(d, cover, strict=True) if not c)
        spans = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        out.append((len(d), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(n=60):
    rng = random.Random(8)
    words = [f"w{k}é" if k % 5 == 0 else f"word{k}" for k in range(300)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(40), prose(70), prose(31), "\0" * 260, "ab" * 150, prose(33)]
    out = [prose(rng.randint(0, 80)) + rng.choice(shared) + prose(rng.randint(0, 60)) + rng.choice(shared)[: rng.randint(150, 400)] + prose(rng.randint(0, 9)) for _ in range(n)]
    out += [out[3], out[3], out[5] + "x", "y" + out[5], out[7][:300] + "Z" + out[7][301:], "a" * 450, "b" * 200, "c" * 199, "b" * 200]
    return out


@pytest.mark.parametrize("most", [2000, 3, 1])
def test_equals_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr("quillspark.llm.repeats.SHARD", 5)
    some = [*texts(), *(t for t in TEXTS if len(t or "") < 3000)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(some)], SCHEMA).selectExpr("*", "1 key", "2 near", "3 spans", "4 tag").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs, most=most).collect()}
    assert got == dict(enumerate(brute(some)))


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr("quillspark.llm.repeats.PIECE", 700)
    monkeypatch.setattr("quillspark.llm.repeats.CHUNK", 900)
    some = texts(30)
    some = ["".join(some[k : k + 6]) for k in range(0, len(some), 5)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(some)], SCHEMA).coalesce(1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs).collect()}
    assert got == dict(enumerate(brute(some)))


def test_repeated_rows_kept_bytes_and_empty(spark):
    docs = documents(spark)
    rows = docs.select("text").collect()
    want = Counter(brute([r.text for r in rows if len(r.text or "") < 3000]))
    got = [r for r in suffix_dedup.remove_repeats(docs.where("coalesce(length(text), 0) < 3000")).collect()]
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(bytes(r.kept_bytes)).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.digests(empty(spark)).collect() == []

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tests.llm.fixtures import SCHEMA, TEXTS, documents, empty

from quillspark.llm import fm_dedup

LENGTH = 35


def brute(texts):
    data = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[p : p + LENGTH]) for d in data for p in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        cover = [False] * len(d)
        for p in range(len(d) - LENGTH + 1):
            if seen[tuple(d[p : p + LENGTH])] > 1:
                cover[p : p + LENGTH] = [True] * LENGTH
        kept = b" ".join(w for w, c in zip(d, cover, strict=True) if not c)
        out.append((len(d), sum(cover), hashlib.sha256(kept).hexdigest()))
    return out


def texts(n=60):
    rng = random.Random(6)
    words = [f"w{k}é" if k % 5 == 0 else f"word{k}" for k in range(300)]
    prose = lambda k: [rng.choice(words) for _ in range(k)]
    shared = [prose(40), prose(70), prose(36), ["x"] * 50, ["a", "b"] * 30, prose(35)]
    out = [prose(rng.randint(0, 80)) + rng.choice(shared) + prose(rng.randint(0, 60)) + rng.choice(shared)[: rng.randint(30, 60)] + prose(rng.randint(0, 9)) for _ in range(n)]
    out += [out[3], out[3], [*out[5], "x"], ["y", *out[5]], [*out[7][:50], "Z", *out[7][51:]], ["q"] * 90, ["r"] * 35, ["s"] * 34, ["r"] * 35]
    return [rng.choice([" ", "\n", "  "]).join(x) for x in out]


@pytest.mark.parametrize("most", [2000, 3, 1])
def test_equals_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr("quillspark.llm.repeats.SHARD", 5)
    some = [*texts(), *(t for t in TEXTS if len(t or "") < 3000)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(some)], SCHEMA).selectExpr("*", "1 key", "2 near", "3 spans", "4 tag").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fm_dedup.digests(docs, most=most).collect()}
    assert got == dict(enumerate(brute(some)))


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(2)
    some = [rng.integers(1, 5, rng.integers(1, 40)) for _ in range(30)]
    flat, sizes = np.concatenate(some), np.array([len(x) for x in some])
    index = fm_dedup.FMIndex(flat, sizes, 4)
    for _ in range(200):
        pattern = rng.integers(1, 5, rng.integers(1, 6))
        lo, hi = np.array([0]), np.array([index.n])
        for w in pattern[::-1]:
            lo, hi = index.extend(np.array([w]), lo, hi)
        want = sum((x[p : p + len(pattern)] == pattern).all() for x in some for p in range(len(x) - len(pattern) + 1))
        assert max(0, int(hi[0] - lo[0])) == want


def test_repeated_rows_kept_text_and_empty(spark):
    docs = documents(spark).where("coalesce(length(text), 0) < 3000")
    want = Counter(brute([r.text for r in docs.select("text").collect()]))
    got = fm_dedup.remove_repeats(docs).collect()
    assert Counter((r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert fm_dedup.digests(empty(spark)).collect() == []

"""N-gram Jaccard join against a brute-force version."""

import random

from pyspark.sql import functions as F

from quillspark.llm import jaccard_join
from tests.llm import fixtures


def brute(rows, size=5, percent=80):
    sets, root = [], {}
    for k, (_, text) in enumerate(rows):
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
        root[k] = k

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    order = sorted(range(len(rows)), key=lambda k: len(sets[k]))
    for at, a in enumerate(order):
        for b in order[at + 1 :]:
            if 100 * len(sets[a]) < percent * len(sets[b]):
                break
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(s), low.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, node string, component string")
    out = jaccard_join.similar(docs, **options)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(len(words) * share)):
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return " ".join(out)


def families(rng, n, longest=400):
    """Chains of edits, copies, size changes and a passage that all texts hold."""
    passage = [f"license{k}" for k in range(40)]
    texts = []
    for family in range(n):
        base = [f"w{family}_{rng.randrange(300)}" for _ in range(rng.randrange(3, longest))]
        texts += [" ".join(base), " ".join(base).upper(), " ".join(base + passage), " ".join(base[: int(len(base) * 0.81)])]
        texts += [edited(rng, base, share) for share in (0.005, 0.01, 0.02, 0.03, 0.05)]
        step = base
        for _ in range(3):
            step = edited(rng, step, 0.015).split()
            texts.append(" ".join(step))
    return texts


def test_families_with_a_common_passage(spark):
    rng = random.Random(3)
    check(spark, list(enumerate(families(rng, 25))))


def test_crowded_tiles_are_cut_into_cells(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    texts = [edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04])) for _ in range(120)]
    check(spark, list(enumerate(texts + [" ".join(f"b{k}" for k in range(60)) + " " + " ".join(f"t{k}_{n}" for k in range(60)) for n in range(60)])), tile=16)


def test_short_texts_at_the_limit(spark):
    words = "a b c d e f g h i j k l m".split()
    check(spark, [(n, " ".join(words[:n])) for n in range(14)] + [(20 + n, " ".join(words[n:])) for n in range(9)] + [(40, "A B"), (41, "a b")])


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    docs = fixtures.documents(spark)
    out = jaccard_join.similar(docs).collect()
    assert sorted(map(tuple, out), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard_join.similar(fixtures.empty(spark)).count() == 0
    assert jaccard_join.similar(docs.where(F.length(F.trim("text")) == 0)).count() == docs.where(F.length(F.trim("text")) == 0).count()


def test_signatures_never_bound_too_low():
    rng = random.Random(1)
    import numpy as np

    for _ in range(200):
        common, x, y = (np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randrange(1, 300))], np.uint64)) for _ in range(3))
        a, b = np.union1d(common, x), np.union1d(common, y)
        x, y = jaccard_join.signature(a, 80), jaccard_join.signature(b, 80)
        bits = int(np.bitwise_count(np.bitwise_xor(*jaccard_join.folded([x, y], min(len(x), len(y))))).sum())
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - bits) // 2

import random
from collections import Counter

import pytest
from tests.llm.fixtures import SCHEMA, documents, empty

from quillspark.llm import decontaminate


def shingles(words, size=5):
    return Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) or Counter([tuple(words)])


def brute(docs, items, similarity=0.8):
    out = {}
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            want = (item or "").lower().split()
            if not want or not words:
                continue
            n = min(len(want), len(words))
            best = max((decontaminate.weighted_similarity(shingles(words[s : s + n]), shingles(want)), -s) for s in range(len(words) - n + 1))
            if best[0] >= similarity:
                out[d, i] = (-best[1], n, round(best[0], 12))
    return out


def data():
    rng = random.Random(9)
    vocab = [f"Word{k}" for k in range(500)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [make(n) for n in [15, 20, 20, 33, 47, 64, 3, 5, 40]] + [["the"] * 20]
    docs = []
    for k in range(300):
        body, item = make(rng.randint(0, 200)), list(rng.choice(items))
        for _ in range(rng.randint(0, 3)):
            item[rng.randrange(len(item))] = rng.choice(vocab)
        cut = rng.randint(0, len(body))
        docs.append((k, " ".join(body[:cut] + (item if k % 3 else []) + body[cut:])))
    docs += [(900, None), (901, ""), (902, "the " * 40), (903, " ".join(items[8][:36]))]
    return docs, [(n, " ".join(x)) for n, x in enumerate(items)] + [(77, None), (78, "")]


@pytest.mark.parametrize("most_items", [10_000, 4])
def test_pairs_equal_brute_force(spark, most_items):
    rows, items = data()
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA).selectExpr("*", "1 item_id", "2 similarity")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, round(r.similarity, 12)) for r in decontaminate.contaminated(docs, bench, most_items=most_items).collect()}
    want = brute(rows, items)
    assert len(want) > 30
    assert got == want
    kept = decontaminate.drop_contaminated(docs, bench, most_items=most_items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {d for d, _ in want}


def test_radius_is_guaranteed():
    import numpy as np

    rng = np.random.default_rng(1)
    index = decontaminate.Index([(n, f"a{n} b{n} c{n} d{n} e{n} f{n}") for n in range(50)] + [(50, "g h i")], 5, 20, 7)
    for fp in index.fps.tolist():
        for d in (0, 5, 15, 20, 23):
            flip = sum(1 << int(b) for b in rng.choice(64, d, replace=False))
            fps = np.array([fp ^ flip], np.uint64)
            want = np.flatnonzero(np.bitwise_count(index.fps[:50] ^ fps) <= 20)
            windows, items = index.near(fps, 6)
            assert items.tolist() == want.tolist() and not windows.any()


def test_repeated_rows_very_long_texts_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STRETCH_BYTES", 1000)
    rows, items = data()
    long = " ".join(f"x{k % 977}" for k in range(60_000))
    rows = [(n, t) for n, (_, t) in enumerate(rows[:40] + rows[:40])] + [(100, long + " " + items[5][1] + " " + long), (None, items[4][1])]
    items = items + [(5, items[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.start_word) for r in decontaminate.contaminated(docs, bench, most_items=3).collect())
    want = Counter((d, i, s) for d, t in rows if d != 100 for (_, i), (s, *_) in brute([(d, t)], items[:-1]).items() for _ in range(2 if i == 5 else 1))
    assert got == want + Counter({(100, 5, 60_000): 2})


#: Least share of the windows of similarity 0.8 or more that lie within the radius.
def test_recall_of_the_radius():
    import numpy as np

    from quillspark.llm.simhash import shingle_hashes

    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(3000)]
    found = []
    for length in (13, 20, 45, 100):
        for _ in range(300):
            item = [rng.choice(vocab) for _ in range(length)]
            other = list(item)
            for _ in range(rng.randint(1, max(1, length // 20))):
                other[rng.randrange(length)] = rng.choice(vocab)
            a, b = (shingle_hashes(" ".join(x), 5) for x in (item, other))
            if decontaminate.weighted_similarity(Counter(a.tolist()), Counter(b.tolist())) >= 0.8:
                x, y = (decontaminate.window_fingerprints(h, len(h))[0] for h in (a, b))
                found.append(int(np.bitwise_count(x ^ y)) <= 20)
    assert len(found) > 200
    assert sum(found) >= 0.99 * len(found)


def test_windows_beyond_the_radius_are_met(spark, tmp_path):
    """Texts of few different shingles: majority bits turn with one shingle more or less."""
    import corpus_pipeline

    items = [(1, "a b " * 6 + "a"), (2, "the cat sat " * 27), (3, " ".join(["one two three four"] * 20))]
    rows = [(1, "b a " * 6 + "b"), (2, "start here " + "cat sat the " * 26 + "the end"), (3, " ".join(["three four one two"] * 19)), (4, "a b a"), (5, "the cat one two three four")]
    rows += [(10 + k, " ".join((["x", "y", "z"][: 1 + k % 3] * 90)[: 9 + 5 * k])) for k in range(12)]
    items += [(10 + k, " ".join((["z", "y", "x"][-1 - k % 3 :] * 90)[: 11 + 5 * k])) for k in range(12)]
    prints = lambda text: decontaminate.window_fingerprints(h := decontaminate.shingle_hashes(text, 5), len(h))[0]
    assert int(prints(rows[0][1]) ^ prints(items[0][1])).bit_count() > 20
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, round(r.similarity, 12)) for r in decontaminate.contaminated(docs, bench).collect()}
    want = brute(rows, items)
    assert (1, 1) in want and got == want
    kept = {i for i, _ in rows} - {d for d, _ in want}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == kept and kept >= {4, 5} and 1 not in kept
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()} == kept


def test_overlaps_are_those_of_multisets():
    rng = random.Random(6)
    for _ in range(200):
        hashes, counts = [rng.randrange(6) for _ in range(rng.randint(1, 40))], Counter(rng.randrange(6) for _ in range(rng.randint(1, 20)))
        width = rng.randint(1, len(hashes))
        assert decontaminate.overlaps(hashes, counts, width).tolist() == [sum((Counter(hashes[w : w + width]) & counts).values()) for w in range(len(hashes) - width + 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(documents(spark), none).collect() == []
    assert decontaminate.contaminated(empty(spark), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).collect() == []

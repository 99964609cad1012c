import random
import re
from collections import Counter

from pyspark.sql import functions as F
from tests.llm.fixtures import SCHEMA, TEXTS, documents, empty

from quillspark.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeat = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed)


def corpus():
    rng = random.Random(1)
    out = []
    for i in range(600):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(300)) for _ in range(rng.randint(40, 200))]
        kind = i % 6
        if kind == 0:
            words = [w + rng.choice("#$%&") for w in words]
        if kind == 1:
            words = [x for w in words for x in (w, "|")]
        out.append((i, "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12)), "en", "s", 0, int(kind > 1)))
    return out


def test_counts_equal_brute_force(spark):
    texts = [*TEXTS, "a b c a b c\n a b \n a b \n\x0b\n\x0b", "x\n" * 80, "one two three", "a b c d a b c", *(r[1] for r in corpus()[:60])]
    docs = documents(spark, texts, extra=False).withColumns({c: F.lit("z") for c in ("n_words", "kept", "order", "bad")})
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.verdicts(docs, []).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_learns_held_out_labels(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:5] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 2] + [(r[0], r[5]) for r in rows if r[0] % 4 == 0] + [(None, 0), (1, None)], "doc_id long, quality int")
    rules = quality.learn(docs, labels)
    assert rules
    verdict = {r.doc_id: (r.base_failed, r.kept) for r in quality.verdicts(docs, rules).collect()}
    held = [r for r in rows if r[0] % 4 == 2 and not verdict[r[0]][0]]
    right = sum(verdict[r[0]][1] == bool(r[5]) for r in held)
    assert right >= 0.95 * len(held)
    kept = quality.keep_good(docs, rules)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, k) in verdict.items() if k}


def test_no_labels_and_empty(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.learn(docs, none) == []
    assert quality.verdicts(empty(spark), []).collect() == []


def test_main_path_is_native(spark):
    plan = quality.verdicts(documents(spark), [(quality.Condition("symbol_ratio", True, 0.1),)])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

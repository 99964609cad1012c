"""Source divergence audit against a brute-force version, where blocks are small and rows are odd."""

import re
from collections import Counter, defaultdict

from tests.llm.fixtures import SCHEMA, empty

from quillspark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), sorted({r[:2] for r in rows})
    for lang, source, text in rows:
        terms = [lower(t) for t in TERM.findall(text)]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = [s for x, s in groups if x == lang]
        total = lambda c: sum(c[t] for t in kept)
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (total(c) + 2 * len(kept))
        everything = sum((counts[lang, s] for s in own), Counter())
        pairs = [(sum(f(share(counts[lang, source], t), share(counts[lang, s], t)) for t in kept), s) for s in own if s != source]
        terms = [(f(p, q), t) for t in kept if counts[lang, source][t] > 0 and (p := share(counts[lang, source], t)) > (q := share(everything, t))]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda r: (-r[0], r[1].encode()))
            for n, (value, item) in enumerate(ranked if part == "pair" else ranked[:top]):
                yield lang, source, part, item, value, n + 1


def check(spark, rows, least=2, top=3, **options):
    docs = spark.createDataFrame([(k, t, lang, s, 0) for k, (lang, s, t) in enumerate(rows)], SCHEMA).selectExpr("*", "1 AS n", "'x' AS term", "2 AS total", "3 AS v")
    out = divergence.audit(docs, min_docs=least, top=top, **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows, least, top))


ROWS = [
    ("en", "a", "The cat, the CAT and éÉ x1y"), ("en", "a", "the dog İ"), ("en", "b", "a dog and a cat"), ("en", "c", None), ("en", None, "the end"), (None, "a", "lone"), ("de", "a", "der Hund"), ("de", "b", "die Katze"),
    ("fr", "only", "le chat le chat"), ("fr", "only", "le chat"), ("en", "a", "The cat, the CAT and éÉ x1y"), ("", "a", ""), ("en", "d", "\x00\x7f123 \t"), ("en", "e", "é É e é"),
]


def test_odd_rows(spark):
    check(spark, ROWS)


def test_small_blocks_and_many_sources(spark):
    import random

    rng = random.Random(4)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)] + ["the"] * 60
    rows = [(rng.choice(["en", "en", "de"]), f"s{rng.randrange(9)}", " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for _ in range(150)]
    for block in (5, 60, 200_000):
        check(spark, rows, least=4, top=10, block=block)


def test_a_task_flushes_what_it_holds(spark):
    docs = spark.createDataFrame([(k, f"common text{'abcdefgh'[k % 8]} more", "en", f"s{k % 3}", 0) for k in range(60)], SCHEMA)
    rows = divergence.partial_counts(docs.coalesce(1), "text", "lang", "source", most=10).groupBy("term").sum("n", "d").collect()
    assert {r.term: (r[1], r[2]) for r in rows}["common"] == (60, 60) and sum(r[1] for r in rows) == 180


def test_empty_and_wordless(spark):
    assert divergence.audit(empty(spark)).count() == 0
    check(spark, [("en", "a", ""), ("en", "b", "1 2"), ("en", "c", None)])

"""Mergeable aggregates, sketches, stems and alignment scores against independent versions."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import stem
from quillspark.functions.text import metric_tokens
from quillspark.operators import aggregates, evaluation, semantics

# --- stems


def measure(w):
    kinds = []
    for k, c in enumerate(w):
        vowel = c in "aeiou" or (c == "y" and k > 0 and kinds[-1] == "c")
        kinds.append("v" if vowel else "c")
    return "".join(kinds)


def m(w):
    return measure(w).count("vc")


def cvc(w):
    return measure(w).endswith("cvc") and w[-1] not in "wxy"


def porter(w):
    """The published steps, one after another."""
    if len(w) < 3 or not (w.isascii() and w.isalpha() and w.islower()):
        return w
    for s, t in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(s):
            w = w[: len(w) - len(s)] + t
            break
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s):
                if "v" in measure(w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and measure(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif m(w) == 1 and cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in measure(w[:-1]):
        w = w[:-1] + "i"
    pairs = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble"
    for table in (pairs, "icate ic ative - alize al iciti ic ical ic ful - ness -"):
        parts = table.split()
        for s, t in sorted(zip(parts[::2], parts[1::2], strict=True), key=lambda r: -len(r[0])):
            if w.endswith(s):
                if m(w[: -len(s)]) > 0:
                    w = w[: -len(s)] + t.strip("-")
                break
    for s in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=lambda s: -len(s)):
        if w.endswith(s):
            base = w[: -len(s)]
            if m(base) > 1 and (s != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and m(w[:-1]) > 1:
        w = w[:-1]
    return w


KNOWN = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper", "decisiveness": "decis", "hopefulness": "hope", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
}


def test_stems_equal_an_independent_version(spark):
    made = [a + b for a in ("syz", "play", "try", "hop", "bal", "crea", "trou", "gyr", "fly", "toy", "exten", "re", "controll", "ad", "y", "o", "by") for b in ("", "s", "es", "ed", "ing", "eed", "y", "ies", "ational", "ization", "fulness", "ness", "ement", "ion", "tion", "sion", "ll", "lled", "zzing", "able", "er", "e", "ative", "iviti", "ism", "ss", "sses")]
    words = sorted({*KNOWN, *made, "a", "is", "été", "don't", "abc1", ""})
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", stem.stem(F.col("w")).alias("s")).collect()}
    assert {w: got[w] for w in KNOWN} == KNOWN == {w: porter(w) for w in KNOWN}
    assert got == {w: porter(w) for w in words}


def test_stems_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(metric_tokens("text")).alias("w")).distinct()
    rows = docs.select("w", stem.stem(F.col("w")).alias("s")).collect()
    assert len(rows) > 1000 and all(r.s == porter(r.w) for r in rows)


def test_rouge_counts_stems(spark):
    pairs = spark.createDataFrame([(1, "the runners were running", "a runner runs"), (2, None, "x"), (3, "", "")], "i long, c string, r string")
    got = {r.i: (round(r.precision, 6), round(r.recall, 6)) for r in evaluation.rouge_n(pairs, "i", "c", "r", 1, stems=True).collect()}
    assert got == {1: (0.5, round(2 / 3, 6)), 2: (0.0, 0.0), 3: (0.0, 0.0)}


# --- aggregates


@pytest.mark.parametrize("parts", [1, 7])
def test_moments_and_fits_merge(spark, parts):
    rng = np.random.default_rng(2)
    rows = [(k, float(x), float(2 * x + e), "extra") for k, n in (("a", 400), ("b", 33), (None, 5), ("one", 1)) for x, e in zip(rng.gamma(2, size=n) + 1e4, rng.normal(size=n), strict=True)]
    rows += [("a", None, 1.0, ""), ("flat", 3.0, 1.0, ""), ("flat", 3.0, 2.0, ""), ("nulls", None, None, "")]
    df = spark.createDataFrame(rows, "k string, x double, y double, state string").repartition(parts)
    got = {r.k: r for r in aggregates.aggregate(df, ["k"], ["x"], aggregates.Moments(), most_keys=2).collect()}
    assert set(got) == {"a", "b", None, "one", "flat"}
    for k in ("a", "b", None):
        x = [r[1] for r in rows if r[0] == k and r[1] is not None]
        mean, std = statistics.fmean(x), statistics.pstdev(x)
        z = [(v - mean) / std for v in x]
        want = (len(x), mean, std, statistics.fmean(v**3 for v in z), statistics.fmean(v**4 for v in z) - 3)
        assert tuple(got[k])[1:] == pytest.approx(want, rel=1e-6)
    assert (got["flat"].n, got["flat"].std, got["flat"].skewness) == (2, 0, None) and got["one"].n == 1
    fit = {r.k: r for r in aggregates.aggregate(df, ["k"], ["x", "y"], aggregates.Fit()).collect()}
    x, y = zip(*((r[1], r[2]) for r in rows if r[0] == "a" and r[1] is not None), strict=True)
    slope, intercept = statistics.linear_regression(x, y)
    assert (fit["a"].correlation, fit["a"].slope) == pytest.approx((statistics.correlation(x, y), slope), rel=1e-6) and fit["a"].intercept == pytest.approx(intercept, rel=1e-4)
    assert fit["flat"].slope is None
    assert aggregates.aggregate(df.limit(0), ["k"], ["x"], aggregates.Moments()).count() == 0


def test_states_are_merged_before_the_shuffle(spark):
    df = spark.range(0, 20_000, 1, 4).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    out = aggregates.aggregate(df, ["k"], ["x"], aggregates.Moments())
    assert out.count() == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowAggregatePython" if "ArrowAggregatePython" in plan else "Exchange") < plan.index("MapInArrow")


def test_sketches_roll_up(spark):
    df = spark.range(200_000).select((F.col("id") % 10).alias("day"), (F.col("id") % 2).alias("k"), (F.col("id") * 7 % 30_011).alias("user"), (F.sqrt(F.col("id"))).alias("v"))
    daily = aggregates.sketch(df, ["day", "k"], "user", "v")
    rolled = {r.k: r for r in aggregates.estimated(aggregates.rolled_up(daily, ["k"]), (0.1, 0.5, 0.99)).collect()}
    for r in df.groupBy("k").agg(F.countDistinct("user").alias("users"), F.count("*").alias("n")).collect():
        got = rolled[r.k]
        assert got.n == r.n and abs(got.n_distinct - r.users) <= 3 * 0.0163 * r.users
        for q, name in ((0.1, "p10"), (0.5, "p50"), (0.99, "p99")):
            low, high = df.where(F.col("k") == r.k).agg(F.percentile("v", F.lit(max(0, q - 0.01))), F.percentile("v", F.lit(min(1, q + 0.01)))).first()
            assert low <= got[name] <= high
    empty = aggregates.estimated(aggregates.rolled_up(aggregates.sketch(df.limit(0), ["day"], "user", "v"), ["day"]))
    assert empty.count() == 0
    nulls = spark.createDataFrame([("a", None, None)], "k string, user string, v double")
    assert tuple(aggregates.estimated(aggregates.sketch(nulls, ["k"], "user", "v")).first()) == ("a", 1, 0, None, None)


# --- alignment scores


def brute_bert(rows, encode, idf):
    tokens = [(i, *("".join(ch for ch in (t or "").lower() if ch not in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").split() for t in (c, r))) for i, c, r in rows]
    df = {}
    for _, _, r in tokens:
        for t in set(r):
            df[t] = df.get(t, 0) + 1
    weight = lambda t: math.log((len(rows) + 1) / (df.get(t, 0) + 1)) if idf else 1.0
    cos = lambda a, b: float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-24))
    for i, c, r in tokens:
        cw, rw = [weight(t) for t in c], [weight(t) for t in r]
        if not c or not r or sum(cw) <= 0 or sum(rw) <= 0:
            yield i, 0.0, 0.0, 0.0
            continue
        x, y = encode(c), encode(r)
        p = sum(w * max(cos(a, b) for b in y) for w, a in zip(cw, x, strict=True)) / sum(cw)
        q = sum(w * max(cos(a, b) for a in x) for w, b in zip(rw, y, strict=True)) / sum(rw)
        yield i, p, q, 2 * p * q / (p + q) if p + q > 0 else 0.0


@pytest.mark.parametrize("idf", [True, False])
def test_bertscore_equals_brute_force(spark, idf):
    rows = [(1, "The cat sat on the mat.", "A cat was sitting on the mat"), (2, "completely different words", "the cat"), (3, None, "x"), (4, "", ""), (5, "same text", "same text"), (5, "the same id", "with the other text, the"), (6, "a b " * 40, "b c a " * 30)]
    df = spark.createDataFrame(rows, "pair long, c string, r string")
    encode = semantics.hashed_tokens(32)
    got = sorted(map(tuple, semantics.bert_score(df, "pair", "c", "r", encode, idf, block=16).collect()))
    want = sorted(brute_bert(rows, encode, idf))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.array([g[1:] for g in got]) == pytest.approx(np.array([w[1:] for w in want]), abs=1e-9)
    assert semantics.bert_score(df.limit(0), "pair", "c", "r", encode).count() == 0

"""Retrieval metrics from ranked lists and relevance judgements; generation, relevance and faithfulness scores of text pairs."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.stem import stemmed
from quillspark.functions.text import bounded, metric_tokens, overlap_tokens


def judged(ranked: DataFrame, relevant: DataFrame, query: str, item: str) -> DataFrame:
    """``ranked`` with hit (0 or 1) and n_relevant of its query."""
    counts = relevant.groupBy(query).agg(F.count("*").alias("n_relevant"))
    marks = relevant.select(query, item, F.lit(1).alias("hit"))
    return ranked.join(marks, [query, item], "left").fillna(0, ["hit"]).join(counts, query, "left").fillna(0, ["n_relevant"])


def judged_by_label(ranked: DataFrame, labelled: DataFrame, query: str, item: str, id_col: str, label: str) -> DataFrame:
    """``judged`` where a query's relevant items are all others of its label: labels are counted and hits compared, the pairs are never listed.

    Ids of ``labelled`` are unique; a null label is relevant to none.
    """
    own = labelled.select(F.col(id_col).alias(query), F.col(label).alias("_own"))
    other = labelled.select(F.col(id_col).alias(item), F.col(label).alias("_label"))
    sizes = labelled.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_own")).agg((F.count("*") - 1).alias("n_relevant"))
    rows = ranked.join(own, query, "left").join(other, item, "left").join(sizes, "_own", "left")
    hit = (F.col("_own") == F.col("_label")) & (F.col(query) != F.col(item))
    return rows.withColumn("hit", F.coalesce(hit, F.lit(False)).cast("int")).fillna(0, ["n_relevant"]).drop("_own", "_label")


def per_query(rows: DataFrame, query: str, ks: list[int]) -> DataFrame:
    """Reciprocal rank, average precision, and precision, recall and NDCG at each k, for each query of judged rows."""
    run = F.sum("hit").over(Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("run", run)
    at = lambda k, v: F.sum(F.when(F.col("rank") <= k, v).otherwise(0.0))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.max("n_relevant").cast("int")))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    share = lambda a, n: F.when(n > 0, a / n).otherwise(0.0)
    n = F.max("n_relevant")
    aggs = [F.coalesce(F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"), share(F.sum(F.when(F.col("hit") == 1, F.col("run") / F.col("rank")).otherwise(0.0)), n).alias("ap")]
    for k in ks:
        aggs += [(at(k, F.col("hit")) / k).alias(f"precision_{k}"), (at(k, F.col("hit")) / F.greatest(F.lit(1), F.least(F.lit(k), F.count("*")))).alias(f"precision_text_{k}"), share(at(k, F.col("hit")), n).alias(f"recall_{k}"), (at(k, F.col("hit") / F.log2(F.col("rank") + 1.0)) / ideal(k)).alias(f"ndcg_{k}")]
    return rows.groupBy(query).agg(*aggs)


def means(rows: DataFrame, queries: DataFrame, query: str) -> DataFrame:
    """Means of all metrics over all queries; one without results counts 0."""
    names = [c for c in rows.columns if c != query]
    full = queries.select(query).distinct().join(rows, query, "left").fillna(0.0, names)
    return full.agg(*(F.avg(n).alias(n) for n in names))


def score_ndcg(rows: DataFrame, relevant: str, scores: str, k: int, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` with ndcg: gains are the scores at the places of an ordered list of relevant items, not grades of a ranking.

    The gain at place i counts if the item there is in ``counted`` (one row with an array ``items``: that of the first query for parity with the starting
    point, by default the row's own list). The ideal order takes as an item's gain the score at the place of its number; items beyond the scores have none.
    """
    rows = rows.join(F.broadcast(counted.select(F.col("items").alias("_counted")))) if counted is not None else rows.withColumn("_counted", F.col(relevant))  # one row
    most = lambda a: F.slice(a, 1, k)
    at = lambda items, gain: F.aggregate(F.zip_with(items, F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))), lambda x, i: F.coalesce(gain(x), F.lit(0.0)) / F.log2(i + 1.0)), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    pairs = most(F.slice(F.arrays_zip(F.col(relevant).alias("i"), F.col(scores).alias("s")), F.lit(1), F.greatest(F.least(F.size(relevant), F.size(scores)), F.lit(0))))
    dcg = at(pairs, lambda x: F.when(F.array_contains("_counted", x["i"]), x["s"]))
    own = lambda x: F.get(F.col(scores), x.cast("int"))
    # Sorted by the score at the item's place in the list, as long as the item's number is within the scores; ties keep the list's order.
    placed = F.transform(F.col(relevant), lambda x, i: F.struct(F.when(x < F.size(scores), -F.coalesce(F.get(F.col(scores), (F.array_position(F.col(relevant), x) - 1).cast("int")), F.lit(0.0))).otherwise(0.0).alias("by"), i.alias("i"), x.alias("x")))
    ideal = at(most(F.transform(F.array_sort(placed), lambda e: e["x"])), lambda x: F.when(x < F.size(scores), own(x)))
    return rows.withColumn("ndcg", F.when(ideal > 0, dcg / ideal).otherwise(0.0)).drop("_counted")


# --- text pairs


def token_f1(candidate: Column | str, reference: Column | str) -> Column:
    """Set F1 in per cent; two empty texts 100, one empty 0."""
    a, b = F.array_distinct(metric_tokens(candidate)), F.array_distinct(metric_tokens(reference))
    n = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 100.0).when((F.size(a) == 0) | (F.size(b) == 0) | (n == 0), 0.0).otherwise(200.0 * n / (F.size(a) + F.size(b)))


def exact_match(candidate: Column | str, reference: Column | str) -> Column:
    same = F.array_join(metric_tokens(candidate), " ") == F.array_join(metric_tokens(reference), " ")
    return F.when(same, 100.0).otherwise(0.0)


def ngrams(tokens: Column, n: int) -> Column:
    def of(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, many).otherwise(F.array().cast("array<string>"))

    # Bound once: within the inner lambda the expression of the tokens would run for every n-gram.
    return F.element_at(F.transform(F.array(tokens), of), 1)


def clipped_overlap(pairs: DataFrame, id_col: str, candidate: str, reference: str, n: int, stems: bool = False) -> DataFrame:
    """(id, overlap, n_candidate, n_reference): n-gram counts, shared ones by the smaller count; ``stems`` counts words of over three letters by their stems."""
    words = lambda c: stemmed(metric_tokens(c)) if stems else metric_tokens(c)
    tokens = pairs.select(id_col, words(candidate).alias("_c"), words(reference).alias("_r"))
    both = tokens.select(id_col, ngrams(F.col("_c"), n).alias("c"), ngrams(F.col("_r"), n).alias("r"))
    sides = both.select(id_col, F.explode("c").alias("g"), F.lit(1).alias("c"), F.lit(0).alias("r")).union(both.select(id_col, F.explode("r"), F.lit(0), F.lit(1)))
    counted = sides.groupBy(id_col, "g").agg(F.sum("c").alias("c"), F.sum("r").alias("r")).groupBy(id_col).agg(F.sum(F.least("c", "r")).alias("overlap"))
    return both.select(id_col, F.size("c").cast("long").alias("n_candidate"), F.size("r").cast("long").alias("n_reference")).join(counted, id_col, "left").fillna(0, ["overlap"])


def rouge_n(pairs: DataFrame, id_col: str, candidate: str, reference: str, n: int = 1, stems: bool = False) -> DataFrame:
    """(id, precision, recall, f1) of n-grams of words, or of their stems."""
    o = clipped_overlap(pairs, id_col, candidate, reference, n, stems)
    p = F.when(F.col("n_candidate") > 0, F.col("overlap") / F.col("n_candidate")).otherwise(0.0)
    r = F.when(F.col("n_reference") > 0, F.col("overlap") / F.col("n_reference")).otherwise(0.0)
    return o.select(id_col, p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def _tokens(text: str | None) -> list[str]:
    return re.sub(r"[!-/:-@\[-`{-~]", "", (text or "").lower()).split()


def bleu(candidate: list[str], reference: list[str], most: int = 4) -> float:
    """Sentence BLEU in per cent; an order without matches is smoothed by ever smaller counts (method 4)."""
    if not candidate or not reference:
        return 0.0
    logs, found = 0.0, 1
    for n in range(1, most + 1):
        grams = lambda t, n=n: Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
        c = grams(candidate)
        hits, total = sum((c & grams(reference)).values()), max(1, sum(c.values()))
        if not hits:
            if n == 1:
                return 0.0
            if len(candidate) > 1:
                hits, found = 1 / (2**found * 5 / math.log(len(candidate))), found + 1
            else:
                return 0.0
        logs += math.log(hits / total) / most
    short = 1.0 if len(candidate) > len(reference) else math.exp(1 - len(reference) / len(candidate))
    return 100 * short * math.exp(logs)


def lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for k, y in enumerate(b, 1):
            corner, row[k] = row[k], corner + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def rouge_l(candidate: list[str], reference: list[str]) -> float:
    n = lcs(candidate, reference)
    return 0.0 if not n else 2 * n / (len(candidate) + len(reference))


def meteor(candidate: list[str], reference: list[str]) -> float:
    """Exact-match METEOR: harmonic mean that favours recall, less a penalty for scattered matches."""
    where: dict[str, list[int]] = {}
    for k, t in enumerate(reference):
        where.setdefault(t, []).append(k)
    pairs = [(k, where[t].pop(0)) for k, t in enumerate(candidate) if where.get(t)]
    if not pairs:
        return 0.0
    chunks = 1 + sum(b[0] != a[0] + 1 or b[1] != a[1] + 1 for a, b in zip(pairs, pairs[1:], strict=False))
    p, r = len(pairs) / len(candidate), len(pairs) / len(reference)
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / len(pairs)) ** 3)


def generation_scores(pairs: DataFrame, id_col: str, candidate: str, reference: str) -> DataFrame:
    """(id, bleu, rouge_l, meteor) in one pass: each text is split once, by one worker a task, a few hundred pairs at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):
            both = [(_tokens(x.as_py()), _tokens(y.as_py())) for x, y in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f(x, y) for x, y in both], pa.float64()) for f in (bleu, rouge_l, meteor))], [id_col, "bleu", "rouge_l", "meteor"])

    kind = pairs.schema[id_col].dataType.simpleString()
    return pairs.select(id_col, F.col(candidate).cast("string"), F.col(reference).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, bleu double, rouge_l double, meteor double")


def overlap_scores(generated: Column | str, source: Column | str) -> dict[str, Column]:
    """Token-overlap faithfulness: precision, recall, F1 and coverage of distinct content words."""
    a, b = overlap_tokens(generated), overlap_tokens(source)
    n, na, nb = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    some = (na > 0) & (nb > 0)
    return {
        "precision": F.when(some, n / na).otherwise(0.0), "recall": F.when(some, n / nb).otherwise(0.0),
        "f1": F.when(some & (n > 0), 2.0 * n / (na + nb)).otherwise(0.0), "coverage": F.when(some, n / F.greatest(na, nb)).otherwise(0.0),
    }


# Claim, temporal and numerical patterns.
CLAIMS = [
    r"(?P<subject>[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:is|are|was|were|has|have|will|would|could|should|may|might)\s+(?P<claim>.+?)[.!?]",
    r"(?P<subject>[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:does|did)\s+(?:not\s+)?(?P<claim>.+?)[.!?]",
    r"The\s+(?P<subject>.+?)\s+(?:is|are|was|were|has|have)\s+(?P<claim>.+?)[.!?]",
    r"(?P<subject>.+?)\s+(?:was|were)\s+(?:founded|established|created|developed)\s+(?P<claim>.+?)[.!?]",
]
TEMPORAL = [
    r"\b(?:in|on|at)\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b\d{4}\b",
    r"\b(?:yesterday|today|tomorrow|last\s+\w+|next\s+\w+)\b",
]
NUMERICAL = [r"\b\d+\.?\d*\s*%", r"\$\d+(?:,\d+)*(?:\.\d+)?", r"\b\d+(?:,\d+)*\b"]


def claim_flags(sentence: Column | str) -> dict[str, Column]:
    c = F.col(sentence) if isinstance(sentence, str) else sentence
    some = lambda ps, flags: F.greatest(*(c.rlike(flags + bounded(p)).cast("int") for p in ps)) == 1
    return {"temporal": some(TEMPORAL, "(?i)"), "numerical": some(NUMERICAL, "")}


#: What Python's patterns match when case is ignored, spelt out for Arrow's: whitespace, letters of a range, and i, s and k.
_SPELT = {
    r"\s": r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]",
    **dict.fromkeys(["[A-Z]", "[a-z]"], r"[A-Za-z\x{130}\x{131}\x{17f}\x{212a}]"), "i": r"[iI\x{130}\x{131}]", "s": r"[sS\x{17f}]", "k": r"[kK\x{212a}]",
}


def linear(pattern: str) -> str:
    """``pattern``, case ignored, for Arrow's expressions, which take time in proportion to the text; the group ``whole`` is the match."""
    spelt = re.sub(r"\(\?P<[a-z]+>|\[[Aa]-[Zz]\]|\\s|[isk]", lambda m: _SPELT.get(m[0], m[0]), pattern)
    return f"(?i)(?P<whole>{spelt})"


def first_claims(sentences: list[str]) -> list[dict | None]:
    """whole and subject of the first pattern that matches, for each sentence."""
    found: list[dict | None] = [None] * len(sentences)
    # Every pattern ends in a terminator, so sentences without one are not searched.
    left = [k for k, s in enumerate(sentences) if re.search(r"[.!?]", s)]
    for p in map(linear, CLAIMS):
        for k, m in zip(left, pc.extract_regex(pa.array([sentences[k] for k in left], pa.large_string()), p).to_pylist(), strict=True):
            found[k] = m
        left = [k for k in left if found[k] is None]
    return found


def claims(df: DataFrame, id_col: str, text_col: str, least_words: int = 6) -> DataFrame:
    """(id, sentence_index, claim, subject, kind): claims by the first pattern that matches a sentence; texts without any give their longer sentences.

    A text may be one long sentence, and patterns that go back try every word of it against every other: they are searched in linear time.
    """
    ends = re.compile(r"(?<![.!?])[.!?]++\s+")
    kinds = pa.schema([("sentence_index", pa.int64()), ("claim", pa.string()), ("subject", pa.string()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):
            texts = [[s for x in ends.split(t.as_py() or "") if (s := x.strip())] for t in b.column(1)]
            found, rows = iter(first_claims([s for ss in texts for s in ss])), []
            for k, ss in enumerate(texts):
                own = [(k, n, m["whole"], m["subject"], "factual") for n, (_, m) in enumerate(zip(ss, found, strict=False)) if m]
                rows += own or [(k, n, s, None, "statement") for n, s in enumerate(ss) if len(s.split()) >= least_words]
            ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds, 1))], [id_col, *kinds.names])

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, sentence_index long, claim string, subject string, kind string")


def weighted_mean(scores: list[Column], weights: list[float]) -> Column:
    """Weighted mean of the scores that are not null; null if all are."""
    total = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in zip(scores, weights, strict=True)), F.lit(0.0))
    value = sum((F.coalesce(s, F.lit(0.0)) * w for s, w in zip(scores, weights, strict=True)), F.lit(0.0))
    return F.when(total > 0, value / total)


def agreement(scores: list[Column]) -> Column:
    """Confidence: 1 less the population deviation of the scores, 0.5 for a single one."""
    known = F.array_compact(F.array(*scores))
    n = F.size(known)
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(F.transform(known, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / n
    return F.when(n == 0, 0.0).when(n == 1, 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - F.sqrt(var)))


def threshold_confidence(score: Column, threshold: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs(score - threshold) / threshold))


def aggregate_scores(rows: DataFrame, score: str, positive: Column, *by: str) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), zero(F.avg(score)).alias("mean"), zero(F.stddev_pop(score)).alias("std"), zero(F.min(score)).alias("lowest"), zero(F.max(score)).alias("highest"), zero(F.avg(positive.cast("double"))).alias("positive_ratio"))


def judged_pairs(rows: DataFrame, score: str, threshold: float = 0.5, truth: str | None = None) -> DataFrame:
    """``rows`` of single pairs with is_relevant, confidence and, where a truth is known, correct."""
    relevant = F.col(score) >= threshold
    out = rows.withColumns({"is_relevant": relevant, "confidence": threshold_confidence(F.col(score), threshold)})
    return out.withColumn("correct", F.when(F.col(truth).isNotNull(), relevant == F.col(truth))) if truth else out


# Weights of the faithfulness methods.
FAITHFULNESS = {"nli": 0.5, "semantic": 0.3, "token": 0.2}


def faithfulness(rows: DataFrame, generated: str, source: str, method: str = "ensemble", threshold: float = 0.5, scorers: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """``rows`` with score, confidence and faithful, by one method or the ensemble of those there are.

    ``token`` is the F1 of content words; ``nli`` and ``semantic`` are injected as functions of (generated, source) columns, since they need a model. A method without
    a scorer raises; the ensemble takes the weights of the methods it has. Null texts count as empty.
    """
    known: dict[str, Callable[[Column, Column], Column]] = {"token": lambda g, s: overlap_scores(g, s)["f1"], **(scorers or {})}
    if method != "ensemble" and method not in known:
        raise ValueError(f"no scorer for {method}" if method in FAITHFULNESS else f"unknown method {method}")
    names = [n for n in FAITHFULNESS if n in known] if method == "ensemble" else [method]
    g, s = (F.coalesce(F.col(c), F.lit("")) for c in (generated, source))
    scored = rows.withColumns({f"{n}_score": known[n](g, s) for n in names})
    cols = [F.col(f"{n}_score") for n in names]
    score = weighted_mean(cols, [FAITHFULNESS[n] for n in names])
    sure = agreement(cols) if len(cols) > 1 else threshold_confidence(score, threshold)
    return scored.withColumns({"score": score, "confidence": sure}).withColumn("faithful", F.col("score") >= threshold)


def consistency(rows: DataFrame, generated: str, context: str, entail: Callable[[Column, Column], Column]) -> DataFrame:
    """``rows`` with consistency: the probability of an injected classifier (a struct of label and p) that the context entails the text, or 1 less it for other labels."""
    out = rows.withColumn("_r", entail(F.coalesce(context, F.lit("")), F.coalesce(generated, F.lit(""))))
    p = F.col("_r.p")
    return out.withColumn("consistency", F.when(F.lower("_r.label") == "entailment", p).otherwise(1.0 - p)).drop("_r")


def self_consistency(samples: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, consistency): the mean token F1, from 0 to 1, of every two samples of one answer; a single sample agrees with itself."""
    rows = samples.select(id_col, text, F.monotonically_increasing_id().alias("_n"))
    a, b = rows.select(id_col, F.col(text).alias("_a"), F.col("_n").alias("_x")), rows.select(id_col, F.col(text).alias("_b"), F.col("_n").alias("_y"))
    pairs = a.join(b, id_col).where("_x < _y")  # samples of an answer are few
    mean = pairs.groupBy(id_col).agg(F.avg(token_f1("_a", "_b") / 100.0).alias("consistency"))
    return samples.select(id_col).distinct().join(mean, id_col, "left").na.fill(1.0, ["consistency"])

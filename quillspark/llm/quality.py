"""Quality rules: base filters and a learned decision list, in DataFrame functions only.

Features come from each whole text with built-in functions. The list is learnt by sequential
covering from labelled texts (quality 0 is bad): a rule starts empty and grows by the threshold
condition of highest information gain on two thirds of the labelled rows, is pruned on the other
third, and is kept if it is precise enough there; rows it covers leave, and the next rule is learnt.
The rules become one ordered conditional expression.

Learning reads at most ``max_labelled`` labelled documents (those whose id hashes lowest), a bound on
what the driver holds; every other figure covers all rows. A document labelled more than once counts
as bad if any label says so; null labels do not count. Without labels of both kinds there are no
rules and the verdict is that of the base filters.

Null and wordless texts have no words and fail the base filter. Repeated rows and null ids each give
their own row; an empty table gives an empty result; internal columns carry the prefix ``_quality``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import words_column

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"),
    "mean_word": ("word_chars", "n_words"), "distinct_ratio": ("n_distinct", "n_words"), "line_words": ("n_words", "n_lines"),
}
FEATURES = (*RATIOS, "n_words")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of three that the text has twice or more. Windows are told apart by 64-bit hashes of their words."""

    def among(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            n = F.size(s)
            same = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(F.filter(s, same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(placed, covered)).otherwise(0)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 4, _let(windows, among)).otherwise(0)


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one more column, the struct ``_quality`` of counts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.withColumns({"_quality_words": words_column(F.col(text_col).cast("string")), "_quality_lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)})
    words, lines = F.col("_quality_words"), F.col("_quality_lines")
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(words).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    return split.withColumn("_quality", counts).drop("_quality_words", "_quality_lines")


def feature(name: str) -> Column:
    if name in RATIOS:
        a, b = RATIOS[name]
        return F.col(f"_quality.{a}") / F.greatest(F.col(f"_quality.{b}"), F.lit(1))
    return F.col(f"_quality.{name}").cast("double")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, row: dict) -> bool:
    return all((row[c.feature] > c.threshold) == c.above for c in rule)


def _cuts(rows: list[dict], name: str, most: int = 32) -> list[float]:
    """Midpoints between neighbouring quantiles of the good and of the bad rows."""
    points: set[float] = set()
    for bad in (False, True):
        values = sorted(r[name] for r in rows if r["bad"] == bad)
        points |= {values[min(len(values) - 1, k * len(values) // most)] for k in range(most + 1)} if values else set()
    ordered = sorted(points)
    return [(a + b) / 2 for a, b in zip(ordered, ordered[1:], strict=False)]


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def _grow(rows: list[dict], cuts: dict[str, list[float]], most: int) -> Rule:
    rule: list[Condition] = []
    while len(rule) < most:
        p0 = sum(r["bad"] for r in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best, found = 1e-9, None
        for name, points in cuts.items():
            ordered = sorted((r[name], r["bad"]) for r in rows)
            at = p = n = 0
            for t in points:
                while at < len(ordered) and ordered[at][0] <= t:
                    p, n, at = p + ordered[at][1], n + (not ordered[at][1]), at + 1
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    if (g := _gain(a, b, p0, n0)) > best:
                        best, found = g, Condition(name, above, t)
        if found is None:
            break
        rule.append(found)
        rows = [r for r in rows if _holds((found,), r)]
    return tuple(rule)


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """The beginning of the rule with the best balance of bad over good rows; the shortest of equals."""

    def worth(k: int) -> float:
        held = [r["bad"] for r in rows if _holds(rule[:k], r)]
        return (2 * sum(held) - len(held)) / len(held) if held else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]


def cover(rows: list[dict], most_rules: int = 12, most_conditions: int = 4, precision: float = 0.95, least: int = 5) -> list[Rule]:
    """Sequential covering; rows hold the features and ``bad``, and alternate between growing (two of three) and pruning."""
    cuts = {name: _cuts(rows, name) for name in FEATURES}
    grow = [r for k, r in enumerate(rows) if k % 3]
    prune = [r for k, r in enumerate(rows) if k % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < most_rules:
        rule = _grow(grow, cuts, most_conditions)
        if not rule:
            break
        rule = _prune(rule, prune)
        held = [r["bad"] for r in grow + prune if _holds(rule, r)]
        tested = [r["bad"] for r in prune if _holds(rule, r)]
        if sum(held) < least or sum(held) < precision * len(held) or sum(tested) < precision * len(tested):
            break
        rules.append(rule)
        grow = [r for r in grow if not _holds(rule, r)]
        prune = [r for r in prune if not _holds(rule, r)]
    return rules


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", max_labelled: int = 20_000, **options) -> list[Rule]:
    """The decision list of labelled documents."""
    marks = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("_quality_id")).agg((F.min(label_col) == 0).alias("_quality_bad"))
    chosen = marks.orderBy(F.xxhash64("_quality_id"), "_quality_id").limit(max_labelled)
    told = docs.select(F.col(id_col).alias("_quality_of"), F.col(text_col)).join(F.broadcast(chosen), F.col("_quality_of") == F.col("_quality_id"))
    features = with_features(told, text_col).select(F.col("_quality_bad").alias("bad"), F.xxhash64("_quality_of").alias("order"), *(feature(f).alias(f) for f in FEATURES))
    rows = [r.asDict() for r in features.orderBy("order", *FEATURES).limit(max_labelled).collect()]
    return cover(rows, **options)


def rejects(rules: list[Rule]) -> Column:
    """The ordered conditional expression of a decision list."""
    if not rules:
        return F.lit(False)
    first, *rest = [[c.column() for c in rule] for rule in rules]
    both = lambda cs: cs[0] if len(cs) == 1 else cs[0] & both(cs[1:])
    out = F.when(both(first), True)
    for cs in rest:
        out = out.when(both(cs), True)
    return out.otherwise(False)


def base_failed() -> Column:
    n = F.col("_quality.n_words")
    return (n < 50) | (100 * F.col("_quality.n_repeat_words") > 50 * n)


def verdicts(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept) of every row."""
    rows = with_features(docs.select(F.col(id_col), F.col(text_col).alias("_quality_text")), "_quality_text")
    return rows.select(F.col(id_col), *(F.col(f"_quality.{c}").alias(c) for c in BASE), base_failed().alias("base_failed"), (~base_failed() & ~rejects(rules)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the base filters or the rules reject.

    A filter on the row number keeps Spark from pushing the verdict below the features: there each mention of
    a feature would be replaced by its whole expression, which makes plans too large to optimise.
    """
    rows = with_features(docs, text_col).withColumn("_quality_row", F.monotonically_increasing_id())
    return rows.where((F.col("_quality_row") >= 0) & ~base_failed() & ~rejects(rules)).drop("_quality", "_quality_row")

"""Queries on aggregates with a mergeable state, stored sketches, stems and alignment scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import stem
from quillspark.functions.text import metric_tokens
from quillspark.operators import aggregates, evaluation, semantics
from quillspark.plans.registry import register
from quillspark.plans.retrieval import _rounded
from quillspark.plans.texts import _PAIRS, _pairs, sql_metric_tokens
from quillspark.session import shared_path, table


@register("udaf_moments", """WITH m AS (SELECT event_type, avg(value) AS mu FROM events GROUP BY ALL), s AS (SELECT e.event_type, count(value) AS n, any_value(mu) AS mean, avg((value - mu) ** 2) AS v, avg((value - mu) ** 3) AS t, avg((value - mu) ** 4) AS f FROM events e JOIN m USING (event_type) GROUP BY ALL)
SELECT event_type, CAST(n AS DOUBLE) AS n, round(mean, 6) AS mean, round(sqrt(v), 6) AS std, round(t / v ** 1.5, 6) AS skewness, round(f / v ** 2 - 3, 6) AS kurtosis FROM s""")
def udaf_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(aggregates.aggregate(table(spark, sf_dir, "events"), ["event_type"], ["value"], aggregates.Moments()), "mean", "std", "skewness", "kurtosis")


@register("udaf_fit", """SELECT l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS n, round(corr(l_extendedprice, l_quantity), 6) AS correlation, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY ALL""")
def udaf_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = aggregates.aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"], aggregates.Fit())
    return fit.withColumns({"correlation": F.round("correlation", 6), "slope": F.round("slope", 4), "intercept": F.round("intercept", 3)})


@register("sketch_rollup", "SELECT event_type, count(*) AS n, TRUE AS distinct_close, TRUE AS p50_close, TRUE AS p95_close FROM events GROUP BY event_type")
def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches kept by day and type, rolled up by type, and whether their estimates are within their error of the exact values: 3 standard errors of a count of
    distinct users, and 1.5 per cent of ranks for quantiles."""
    events = table(spark, sf_dir, "events")
    path = shared_path(spark, "sketches")
    aggregates.sketch(events.withColumn("day", F.to_date("ts")), ["day", "event_type"], "user_id", "value").write.parquet(path)
    found = aggregates.estimated(aggregates.rolled_up(spark.read.parquet(path), ["event_type"]))
    ranks = [F.percentile("value", F.lit(q)).alias(f"q{n}") for n, q in enumerate((0.485, 0.515, 0.935, 0.965))]
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), *ranks)
    close = F.abs(F.col("n_distinct") - F.col("users")) <= F.greatest(F.lit(1.0), 3 * 0.0163 * F.col("users"))
    return found.join(exact, "event_type").select("event_type", "n", close.alias("distinct_close"), F.col("p50").between(F.col("q0"), F.col("q1")).alias("p50_close"), F.col("p95").between(F.col("q2"), F.col("q3")).alias("p95_close"))


def _sql_rules(rules, word: str) -> str:
    whens = []
    for suffix, condition, to in sorted(rules, key=lambda r: -len(r[0])):
        base = f"left({word}, length({word}) - {len(suffix)})"
        new = f"{base} || '{to}'"
        value = new if not condition else f"CASE WHEN regexp_matches({base}, '{stem.CONDITIONS[condition]}') THEN {new} ELSE {word} END"
        whens.append(f"WHEN ends_with({word}, '{suffix}') THEN {value}")
    return f"CASE {' '.join(whens)} ELSE {word} END"


def sql_stems(words: str) -> str:
    """CTEs that end in stems (word, stem) of the distinct words of a table."""
    cut = lambda k: f"left(w, length(w) - {k})"
    m0, m1, m2 = stem.CONDITIONS["m>0"], stem.M1, stem.CONDITIONS["m>1"]
    short = lambda s: f"(regexp_matches({s}, '{m1}') AND regexp_matches({s}, '{stem.SHORT}'))"
    double = "regexp_matches(w, '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$')"
    steps = [
        _sql_rules(stem.STEP_1A, "w"),
        None,
        f"CASE WHEN regexp_matches(w, '[yY]$') AND regexp_matches({cut(1)}, '[aeiouY]') THEN {cut(1)} || 'i' ELSE w END",
        _sql_rules(stem.STEP_2, "w"),
        _sql_rules(stem.STEP_3, "w"),
        f"CASE WHEN ends_with(w, 'ion') THEN CASE WHEN regexp_matches({cut(3)}, '[st]$') AND regexp_matches({cut(3)}, '{m2}') THEN {cut(3)} ELSE w END ELSE {_sql_rules(stem.STEP_4, 'w')} END",
        f"CASE WHEN ends_with(w, 'e') AND (regexp_matches({cut(1)}, '{m2}') OR (regexp_matches({cut(1)}, '{m1}') AND NOT {short(cut(1))})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND regexp_matches({cut(1)}, '{m2}') THEN {cut(1)} ELSE w END",
    ]
    ctes = [f"st0 AS (SELECT DISTINCT word, regexp_replace(word, '([bcdfghjklmnpqrstvwxz])y', '\\1Y', 'g') AS w FROM {words})"]
    for n, step in enumerate(steps):
        if step is None:  # -eed, -ed, -ing, of which the latter two mend what is left
            ctes.append(f"""stx AS (SELECT word, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches({cut(3)}, '{m0}') THEN {cut(1)} ELSE w END
WHEN ends_with(w, 'ed') AND regexp_matches({cut(2)}, '[aeiouY]') THEN {cut(2)} WHEN ends_with(w, 'ing') AND regexp_matches({cut(3)}, '[aeiouY]') THEN {cut(3)} ELSE w END AS w,
NOT ends_with(w, 'eed') AND ((ends_with(w, 'ed') AND regexp_matches({cut(2)}, '[aeiouY]')) OR (ends_with(w, 'ing') AND regexp_matches({cut(3)}, '[aeiouY]'))) AS cut FROM st{n})""")
            ctes.append(f"st{n + 1} AS (SELECT word, CASE WHEN NOT cut THEN w WHEN {double} THEN {cut(1)} WHEN regexp_matches(w, '(at|bl|iz)$') OR {short('w')} THEN w || 'e' ELSE w END AS w FROM stx)")
        else:
            ctes.append(f"st{n + 1} AS (SELECT word, {step} AS w FROM st{n})")
    return ",\n".join(ctes) + f",\nstems AS (SELECT word, CASE WHEN regexp_matches(word, '^[a-z]+$') AND length(word) > 2 THEN lower(w) ELSE word END AS stem FROM st{len(steps)})"


_WORDS = f"v AS (SELECT DISTINCT unnest({sql_metric_tokens('text')}) AS word FROM documents WHERE lang = 'en')"


@register("stem_words", f"WITH {_WORDS},\n{sql_stems('v')}\nSELECT word, stem FROM stems")
def stem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(metric_tokens("text")).alias("word")).distinct()
    return words.select("word", stem.stem(F.col("word")).alias("stem"))


_SIDES = {s: sql_metric_tokens(s) for s in ("candidate", "reference")}
_STEMMED = f"""WITH {_PAIRS}, v AS (SELECT DISTINCT unnest({_SIDES['candidate']}) AS word FROM p UNION SELECT DISTINCT unnest({_SIDES['reference']}) FROM p),
{sql_stems('v')},
u AS (SELECT pair_id, unnest({_SIDES['candidate']}) AS word, 1 AS c, 0 AS r FROM p UNION ALL SELECT pair_id, unnest({_SIDES['reference']}), 0, 1 FROM p),
k AS (SELECT pair_id, CASE WHEN length(word) > 3 THEN stem ELSE word END AS g, sum(c) AS c, sum(r) AS r FROM u JOIN stems USING (word) GROUP BY ALL),
x AS (SELECT p.pair_id, coalesce(sum(least(c, r)), 0) AS o, coalesce(sum(c), 0) AS nc, coalesce(sum(r), 0) AS nr FROM p LEFT JOIN k USING (pair_id) GROUP BY ALL),
y AS (SELECT pair_id, CASE WHEN nc > 0 THEN o / nc ELSE 0 END AS p, CASE WHEN nr > 0 THEN o / nr ELSE 0 END AS r FROM x)
SELECT pair_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM y"""


@register("gen_rouge1_stemmed", _STEMMED)
def gen_rouge1_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.rouge_n(_pairs(spark, sf_dir), "pair_id", "candidate", "reference", 1, stems=True), "precision", "recall", "f1")


@register("gen_bertscore")
def gen_bertscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(semantics.bert_score(_pairs(spark, sf_dir), "pair_id", "candidate", "reference", semantics.hashed_tokens()), "precision", "recall", "f1")

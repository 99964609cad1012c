"""Answers of a language model, cleaned, told by format, scored and traced to their sources in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text


def valid_sources(cited: Column, available: Column) -> Column:
    """Cited sources that an available one contains, or that contain an available one, in any case."""
    match = lambda c: F.exists(available, lambda a: F.contains(F.lower(a), F.lower(c)) | F.contains(F.lower(c), F.lower(a)))
    return F.filter(cited, match)


def processed(df: DataFrame, response: str, context: str | None = None, available: str | None = None, expected: str | None = None, aggressive: bool = False, suspicious: float = 0.3) -> DataFrame:
    """``df`` with cleaned, format, confidence, hallucination_score, has_hallucination and sources of each response.

    Everything is taken from the cleaned text. ``context`` names a column whose null lowers the confidence; ``available`` one of arrays of known sources,
    which limit the cited ones where they are not null; ``expected`` one of formats that are taken as they are where not null. A null or
    empty response is an empty text without confidence, of the expected format or ``text``.
    """
    some = F.length(F.coalesce(F.col(response), F.lit(""))) > 0
    t = F.col("cleaned")
    out = df.withColumn("cleaned", F.when(some, text.clean(response, aggressive)).otherwise(""))
    sure = F.when(F.col(context).isNull(), text.confidence(t, False)).otherwise(text.confidence(t)) if context else text.confidence(t, False)
    score = text.hallucination(t)
    cited = text.citations(t)
    kept = F.when(F.col(available).isNull(), cited).otherwise(valid_sources(cited, F.col(available))) if available else cited
    told = F.when(some, text.detect_format(t)).otherwise("text")
    none = F.array().cast("array<string>")
    return out.withColumns(
        {
            "format": F.coalesce(F.col(expected), told) if expected else told,
            "confidence": F.when(some, sure).otherwise(0.0),
            "hallucination_score": F.when(some, score).otherwise(0.0),
            "has_hallucination": F.when(some, score > suspicious).otherwise(F.lit(False)),
            "sources": F.when(some, kept).otherwise(none),
        }
    )

"""Registered queries of the training-data operators, with the digest columns their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.warc import archive_digests

    return archive_digests(spark, _table(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), limit=512)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.bpe import encode_decode_digests

    return encode_decode_digests(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.verdicts(docs, quality.learn(docs, _table(spark, sf_dir, "labels"), max_labelled=20_000))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.suffix_dedup import digests

    return digests(_table(spark, sf_dir, "documents"))


def op6_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.fm_dedup import digests

    return digests(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.sstable import write_and_scan

    return write_and_scan(spark, _table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), size=4, most=4)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=5, similarity=0.8)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.jaccard_join import similar

    return similar(_table(spark, sf_dir, "documents"), size=5, percent=80)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.alignment import align

    return align(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.divergence import audit

    return audit(_table(spark, sf_dir, "documents"), min_docs=10, top=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_token_counts, op3_bpe_round_trip, op4_quality_rules, op5_suffix_dedup, op6_fm_dedup, op7_secret_scan, op8_sstable, op9_simhash, op10_decontaminate, op11_jaccard_join, op12_alignment, op13_divergence, pipeline)}


def oracle_sql() -> dict[str, str]:
    from quillspark.llm import decontaminate, divergence, fm_dedup, jaccard_join, suffix_dedup, warc

    return {"op1_warc": warc.ORACLE, "op5_suffix_dedup": suffix_dedup.ORACLE, "op6_fm_dedup": fm_dedup.ORACLE, "op10_decontaminate": decontaminate.ORACLE, "op11_jaccard_join": jaccard_join.ORACLE, "op13_divergence": divergence.ORACLE}

"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, imatch, langid, lm, ngram_join, packing, phrases, quality, runs, sharding, substring_dedup, token_counts

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(_documents(spark, sf_dir))


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), VOCABULARY)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))[0]


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substring_dedup.repeated_spans(_documents(spark, sf_dir))
    return spans.select("doc_id", "start", "end", "kept_doc_id", "kind", "component")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_documents(spark, sf_dir), VOCABULARY)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_passages(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_documents(spark, sf_dir))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(_documents(spark, sf_dir))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "host", "path", "p_bad", "p_toxic", "keep")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language."""
    return phrases.collocations(_documents(spark, sf_dir))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; null texts count as empty."""
    return token_counts.count_tokens(_documents(spark, sf_dir), WORD_VOCABULARY)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every document, about a tenth of them with a cycle put in."""
    return runs.run_digests(runs.periodic_runs(runs.with_cycles(_documents(spark, sf_dir))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top, counted as part of this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_ngram_join,
        op2_token_packing,
        op3_sharding,
        op4_substring_dedup,
        op5_byte_bpe,
        op6_decontamination,
        op7_language_id,
        op8_imatch,
        op9_lm_scoring,
        op10_quality,
        op11_phrases,
        op12_token_counts,
        op13_periodic_runs,
        pipeline,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op11_phrases": phrases.COLLOCATIONS_SQL}

"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxspark.llm import backoff_lm, bagminhash, bucket_refinement, decontaminate, language_id, licenses, line_dedup, packing, quality, sharding
from voxspark.llm.shared import benchmark, documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_windows": lambda spark, d: decontaminate.contaminated(documents(spark, d), benchmark(spark, d)),
        "op2_compression_bands": lambda spark, d: quality.quality_digest(documents(spark, d)),
        "op3_bm25_packing": lambda spark, d: packing.pack_documents(documents(spark, d)),
        "op4_backoff_automaton": lambda spark, d: backoff_lm.lm_scores(documents(spark, d)),
        "op5_word_first_backoff": lambda spark, d: language_id.languages(documents(spark, d)),
        "op6_bagminhash": lambda spark, d: bagminhash.near_duplicates(documents(spark, d)),
        "op7_line_dedup": lambda spark, d: line_dedup.line_dedup_digest(documents(spark, d)),
        "op8_winnowed_licenses": lambda spark, d: licenses.license_spans(documents(spark, d)),
        "op9_bucket_refinement": lambda spark, d: bucket_refinement.remove_repeats_digest(documents(spark, d)),
        "op10_hypergeometric_sharding": lambda spark, d: sharding.sharding_digest(documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": line_dedup.DIGEST_SQL}

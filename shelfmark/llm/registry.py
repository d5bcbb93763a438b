"""The registered queries of this folder and, where SQL can express one, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe,
    embedding_dedup,
    exact_dedup,
    jaccard_join,
    kd_shards,
    maxent,
    merkle,
    packing,
    quality,
    quotations,
    substring_dedup,
    toxicity,
    whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_maxent": maxent.op1_maxent,
        "op2_kd_shards": kd_shards.op2_kd_shards,
        "op3_quotations": quotations.op3_quotations,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
        "op7_bpe": bpe.op7_bpe,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_packing": packing.op10_packing,
        "op11_merkle": merkle.op11_merkle,
        "op12_whitening": whitening.op12_whitening,
        "op13_quality": quality.op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return exact_dedup.ORACLE | quotations.ORACLE | merkle.ORACLE

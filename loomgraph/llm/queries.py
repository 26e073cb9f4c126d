"""The queries of this subpackage, by name, and the SQL that states them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, hard_negatives, language_id, license_scan, near_dup, pii, quality_classifier, quality_rules, secrets_scan, sentencepiece_codec, source_divergence, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_secrets": secrets_scan.op2_secrets,
        "op3_near_dup": near_dup.op3_near_dup,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_language_id": language_id.op5_language_id,
        "op6_sentencepiece": sentencepiece_codec.op6_sentencepiece,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_pii": pii.op8_pii,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_byte_bpe": byte_bpe.op12_byte_bpe,
        "op13_source_divergence": source_divergence.op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.ORACLE, "op2_secrets": secrets_scan.oracle(), "op8_pii": pii.ORACLE, "op3_near_dup": near_dup.ORACLE, "op4_decontaminate": decontaminate.ORACLE, "op7_suffix_dedup": suffix_dedup.ORACLE, "op9_quality_rules": quality_rules.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op13_source_divergence": source_divergence.ORACLE}

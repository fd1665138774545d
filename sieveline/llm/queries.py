"""Queries of the text operators over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import html_extract, knn_join, license_scan, line_dedup, minhash, mixing, quality_classifier, quality_rules, sentencepiece_wfst, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def over(operator: Callable[..., DataFrame], *tables: str) -> Query:
    """The operator over whole tables."""
    return lambda spark, sf_dir: operator(*[spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in tables])


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": over(sentencepiece_wfst.tokenized, "documents"),
        "op2_html_extraction": over(html_extract.extract_text, "pages"),
        "op3_mixing": over(mixing.mixed_documents, "documents"),
        "op4_quality_rules": over(quality_rules.rule_verdicts, "documents"),
        "op5_toxicity": over(toxicity.toxicity_scores, "documents", "labels"),
        "op6_quality_classifier": over(quality_classifier.classify, "documents"),
        "op7_top_k": over(knn_join.nearest_vectors, "embeddings"),
        "op8_license_scan": over(license_scan.license_verdicts, "documents"),
        "op9_line_dedup": over(line_dedup.deduplicated_lines, "documents"),
        "op10_near_dedup": over(minhash.near_duplicate_rows, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality_rules.rules_sql(), "op7_top_k": knn_join.KNN_SQL}

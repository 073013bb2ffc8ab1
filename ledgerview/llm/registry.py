"""Queries of this subpackage for the entry module."""

from __future__ import annotations

import corpus_pipeline
from ledgerview.llm import decontaminate, line_dedup, lm_score, packing, pii, quality_knn, quality_rules, secret_scan, simhash_dedup, token_counts


def queries():
    return {
        "op1_token_counts": token_counts.query,
        "op2_decontaminate": decontaminate.query,
        "op3_quality_knn": quality_knn.query,
        "op4_line_dedup": line_dedup.query,
        "op5_packing": packing.query,
        "op6_quality_rules": quality_rules.query,
        "op7_secret_scan": secret_scan.query,
        "op8_pii": pii.query,
        "op9_lm_score": lm_score.query,
        "op10_simhash_dedup": simhash_dedup.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op6_quality_rules": quality_rules.ORACLE_SQL}

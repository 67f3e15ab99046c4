"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from strandflow.llm import license_scan, lm_score, mixing, packing, pii, quality, secrets, simhash, topk, url_filter

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_pii_surrogates": pii.op3_pii_surrogates,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_mix": mixing.op6_mix,
    "op7_pack": packing.op7_pack,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_simhash": simhash.op9_simhash,
    "op10_top_k": topk.op10_top_k,
}

ORACLE_SQL = {
    "op6_mix": mixing.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op10_top_k": topk.ORACLE_SQL,
}

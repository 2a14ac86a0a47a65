"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import byte_bpe, fingerprints, kd_shards, mixing, quality_rules, simhash, substring_dedup, suffix_array_dedup, toxicity, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_cdc_fingerprints": fingerprints.op3_cdc_fingerprints,
    "op4_suffix_array_dedup": suffix_array_dedup.op4_suffix_array_dedup,
    "op5_warc": warc.op5_warc,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_simhash": simhash.op7_simhash,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_kd_shards": kd_shards.op10_kd_shards,
}
ORACLES: dict[str, str] = {"op5_warc": warc.ORACLE}

"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import exact_dedup, langid, lm, mixing, neardup, packing, quality, sharding, toxicity, warc

_QUERIES = (quality.op1_quality_rules, exact_dedup.op2_stream_dedup, warc.op3_revisits, langid.op4_mixture_languages, sharding.op5_jump_shards, mixing.op6_pfair_mixing, packing.op7_nnls_packing, lm.op8_trie_scores, neardup.op9_minhash_join, toxicity.op10_recurrent_toxicity)
_ORACLES = (quality.ORACLE, exact_dedup.ORACLE, warc.ORACLE)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _ORACLES for name, sql in part.items()}

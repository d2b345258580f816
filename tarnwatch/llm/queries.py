"""Registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from tarnwatch.llm import decontaminate, filter_audit, language_id, mixing, near_dedup, neighbours, packing, phrases, quality, repeats, secret_scan, sharding, toxicity

QUERIES = {
    "op1_shards": sharding.op1_shards,
    "op2_secrets": secret_scan.op2_secrets,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_language": language_id.op5_language,
    "pages_language": language_id.pages_language,
    "op6_mix": mixing.op6_mix,
    "op7_suffixes": repeats.op7_suffixes,
    "op8_quality": quality.op8_quality,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_minhash": near_dedup.op10_minhash,
    "op11_phrases": phrases.op11_phrases,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_pack": packing.op13_pack,
}

ORACLE_SQL = {
    "op1_shards": sharding.OP1_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_neighbours": neighbours.OP4_SQL,
    "op6_mix": mixing.OP6_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}

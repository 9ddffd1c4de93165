"""Queries of the training-data operators: one per operator over its whole table."""
from __future__ import annotations

from strata.llm import chunk_dedup, conversations, decontaminate, katz, line_dedup, minhash_dedup, packing, quality, simhash, spotsigs, toxicity, url_filter, variants

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_katz": katz.op2_katz,
    "op3_quality": quality.op3_quality,
    "op4_spotsigs": spotsigs.op4_spotsigs,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_packing": packing.op6_packing,
    "op7_minhash_dedup": minhash_dedup.op7_minhash_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_chunk_dedup": chunk_dedup.op10_chunk_dedup,
    "op11_variants": variants.op11_variants,
    "op12_conversations": conversations.op12_conversations,
    "op13_simhash": simhash.op13_simhash,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
}

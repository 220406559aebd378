"""Queries of this subpackage for the driver's entry file."""

from __future__ import annotations

from . import ann, bpe, chat, langid, lm, mixing, neardup, pii, repair, runs, secrets, shingles, tokencount

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_pii": pii.op2_pii,
    "op3_secrets": secrets.op3_secrets,
    "op4_shingle_join": shingles.op4_shingle_join,
    "op5_near_dup_vectors": neardup.op5_near_dup_vectors,
    "op6_nearest_vectors": ann.op6_nearest_vectors,
    "op7_chat_format": chat.op7_chat_format,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_lm_score": lm.op10_lm_score,
    "op11_token_counts": tokencount.op11_token_counts,
    "op12_repair_conversations": repair.op12_repair_conversations,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLES = {
    "op4_shingle_join": shingles.OP4_SQL,
    "op5_near_dup_vectors": neardup.OP5_SQL,
    "op6_nearest_vectors": ann.OP6_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op12_repair_conversations": repair.OP12_SQL,
}

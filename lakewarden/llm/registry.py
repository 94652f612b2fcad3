"""The corpus queries by name, and their SQL where SQL can say it."""

from __future__ import annotations

from lakewarden.llm import clusters, html_text, interactions, matroska, mixing, near_dup, packing, pii, quality, repeats, tokens, toxicity, vectors

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_posting_lists": vectors.op2_posting_lists,
    "op3_near_dup": near_dup.op3_near_dup,
    "op4_html_text": html_text.op4_html_text,
    "op5_quality": quality.op5_quality,
    "op6_mixing": mixing.op6_mixing,
    "op7_matroska": matroska.op7_matroska,
    "op8_token_planes": tokens.op8_token_planes,
    "op9_packing": packing.op9_packing,
    "op10_pii": pii.op10_pii,
    "op11_seed_extend": repeats.op11_seed_extend,
    "op12_exponion": clusters.op12_exponion,
    "op13_filter_audit": interactions.op13_filter_audit,
}
ORACLES = {
    "op3_near_dup": near_dup.OP3_SQL,
    "op4_html_text": html_text.OP4_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op11_seed_extend": repeats.OP11_SQL,
    "op12_exponion": clusters.OP12_SQL,
    "op13_filter_audit": interactions.OP13_SQL,
}

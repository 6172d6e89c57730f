"""Queries of this folder: name to (function of session and table folder, DuckDB SQL or None)."""

from . import blocks, mixture, parity_join, quotes, repetition, secrets, simple8b, suffix_index, templates, toxicity

QUERIES = {
    "op1_toxicity": (toxicity.query, toxicity.SQL),
    "op2_repetition": (repetition.query, repetition.SQL),
    "op3_quotes": (quotes.query, quotes.SQL),
    "op4_suffix_index": (suffix_index.query, suffix_index.SQL),
    "op5_simple8b": (simple8b.query, simple8b.SQL),
    "op6_parity_join": (parity_join.query, parity_join.SQL),
    "op7_mixture": (mixture.query, mixture.SQL),
    "op8_blocks": (blocks.query, blocks.SQL),
    "op9_secrets": (secrets.query, secrets.SQL),
    "op10_templates": (templates.query, templates.SQL),
}

"""Queries of this subpackage and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, html_text, licenses, lm, pii, quality, simhash, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_simhash": simhash.op2_simhash,
    "op3_lm_scores": lm.op3_lm_scores,
    "op4_pii": pii.op4_pii,
    "op5_html_text": html_text.op5_html_text,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_licenses": licenses.op8_licenses,
    "op9_bpe": bpe.op9_bpe,
    "op10_chat": chat.op10_chat,
}
ORACLES = {"op6_decontaminate": decontaminate.SQL, "op7_quality_rules": quality.sql(), "op8_licenses": licenses.sql(), "op10_chat": chat.SQL}

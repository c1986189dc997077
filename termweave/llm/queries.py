"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from termweave.llm import chat, decontaminate, line_dedup, line_labels, mixing, near_dedup, pii, quality, token_counts, warc

QUERIES = {
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op3_quality": quality.op3_quality,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op1_token_counts": token_counts.op1_token_counts,
    "op4_warc": warc.op4_warc,
    "op5_mixing": mixing.op5_mixing,
    "op6_pii": pii.op6_pii,
    "op9_chat_format": chat.op9_chat_format,
    "op10_quality_rules": line_labels.op10_quality_rules,
}
ORACLES = {
    "op2_near_dedup": near_dedup.OP2_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op1_token_counts": token_counts.OP1_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_pii": pii.OP6_SQL,
    "op9_chat_format": chat.OP9_SQL,
}

"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from clusterloom.llm import ann, chat, mixing, near_join, packing, ppm, repeats, secrets, tokens, webp


def queries():
    return {
        "op1_webp": webp.op1_webp,
        "op2_language_id": ppm.op2_language_id,
        "op3_tokens": tokens.op3_tokens,
        "op4_secrets": secrets.op4_secrets,
        "op5_near_join": near_join.op5_near_join,
        "op6_repeats": repeats.op6_repeats,
        "op7_nearest": ann.op7_nearest,
        "op8_packing": packing.op8_packing,
        "op9_mixing": mixing.op9_mixing,
        "op10_chat": chat.op10_chat,
    }


def oracle_sql():
    return {"op4_secrets": secrets.ORACLE, "op9_mixing": mixing.ORACLE, "op10_chat": chat.ORACLE}

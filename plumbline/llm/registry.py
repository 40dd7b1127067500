"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from plumbline.llm import bpe, chat, decontam, fim, html_extract, knn, langid, neardup, pii, quality, repair, shards, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_bpe": bpe.op2_bpe,
        "op3_pii": pii.op3_pii,
        "op4_chat_format": chat.op4_chat_format,
        "op5_top_k": knn.op5_top_k,
        "op6_decontaminate": decontam.op6_decontaminate,
        "op7_token_shards": shards.op7_token_shards,
        "op8_html": html_extract.op8_html,
        "op9_language_id": langid.op9_language_id,
        "op10_near_duplicates": neardup.op10_near_duplicates,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_warc": warc.op12_warc,
        "op13_conversation_repair": repair.op13_conversation_repair,
    }


def oracle_sql() -> dict:
    return {
        "op4_chat_format": chat.ORACLE, "op5_top_k": knn.ORACLE, "op6_decontaminate": decontam.ORACLE, "op10_near_duplicates": neardup.ORACLE,
        "op11_fill_in_middle": fim.ORACLE, "op12_warc": warc.ORACLE, "op13_conversation_repair": repair.ORACLE,
    }

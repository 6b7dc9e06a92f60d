"""Queries of the training-data operators, and their SQL where SQL can say them."""

from . import ann, chat, decontaminate, html_text, language_id, mixing, simhash, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_html_extract": html_text.query,
    "op3_chat_format": chat.query,
    "op4_mixing": mixing.query,
    "op5_language_id": language_id.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_toxicity": toxicity.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_warc": warc.query,
    "op10_ann": ann.query,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op3_chat_format": chat.SQL,
    "op4_mixing": mixing.SQL,
    "op9_warc": warc.SQL,
}

"""Queries of the corpus operators by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from timberline.llm import bpe, codes, embeddings, html, language, mining, mixing, secrets, simhash, substrings, topk, urls, wordbpe

QUERIES = {
    "op1_byte_bpe": bpe.query,
    "op2_embeddings": embeddings.query,
    "op3_urls": urls.query,
    "op4_html": html.query,
    "op5_mixing": mixing.query,
    "op6_simhash": simhash.query,
    "op7_secrets": secrets.query,
    "op8_topk": topk.query,
    "op9_substrings": substrings.query,
    "op10_language": language.query,
    "op11_negatives": mining.query,
    "op12_word_bpe": wordbpe.query,
    "op13_codes": codes.query,
}

ORACLES: dict[str, str] = {
    "op2_embeddings": embeddings.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_secrets": secrets.ORACLE,
    "op8_topk": topk.ORACLE,
    "op9_substrings": substrings.ORACLE,
    "op11_negatives": mining.ORACLE,
    "op13_codes": codes.ORACLE,
}

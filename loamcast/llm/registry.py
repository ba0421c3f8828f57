"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, clusters, decontamination, langid, lm, media, neardup, packing, passages, quality, tokencount, urls, whitening

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_near_duplicates": neardup.query,
    "op3_quality": quality.query,
    "op4_token_counts": tokencount.query,
    "op5_language": langid.query,
    "op6_passages": passages.query,
    "op7_packing": packing.query,
    "op8_media": media.query,
    "op9_chat": chat.query,
    "op10_url_filter": urls.query,
    "op11_whitening": whitening.query,
    "op12_clusters": clusters.query,
    "op13_language_model": lm.query,
}

ORACLE_SQL = {"op1_decontamination": decontamination.ORACLE, "op9_chat": chat.ORACLE, "op10_url_filter": urls.ORACLE, "op12_clusters": clusters.ORACLE}

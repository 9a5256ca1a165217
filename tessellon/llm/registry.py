"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from tessellon.llm import bpe, chat, jaccard, kdtree, langid, lexical, packing, quality, repair, urlfilter, voronoi, warc, wrappers

#: Module of each operator's query.
OPERATORS = {
    "op1_packing": packing,
    "op2_knn": voronoi,
    "op3_html": wrappers,
    "op4_url_filter": urlfilter,
    "op5_bpe": bpe,
    "op6_ngram_join": jaccard,
    "op7_langid": langid,
    "op8_chat": chat,
    "op9_warc": warc,
    "op10_quality": quality,
    "op11_repair": repair,
    "op12_ann": kdtree,
    "op13_lexical": lexical,
}


def queries() -> dict:
    return {name: m.query for name, m in OPERATORS.items()}


def oracle_sql() -> dict:
    return {name: m.ORACLE for name, m in OPERATORS.items() if getattr(m, "ORACLE", None)}

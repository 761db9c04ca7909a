"""Queries of the numbered operators, and SQL for those that it can express."""

from __future__ import annotations

from . import centroids, chat, decontaminate, embeddings, lines, mixing, neardup, ngram, phrases, pieces, quality, sharding, toxicity

QUERIES = {
    "op1_lm_scoring": ngram.query,
    "op2_chat": chat.query,
    "op3_embedding_dedup": embeddings.query,
    "op4_jaccard_join": neardup.query,
    "op5_mixing": mixing.query,
    "op6_line_dedup": lines.query,
    "op7_sharding": sharding.query,
    "op8_decontamination": decontaminate.query,
    "op9_toxicity": toxicity.query,
    "op10_quality": quality.query,
    "op11_phrases": phrases.query,
    "op12_centroid_clustering": centroids.query,
    "op13_sentencepiece": pieces.query,
}

ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": lines.SQL,
    "op8_decontamination": decontaminate.SQL,
    "op11_phrases": phrases.SQL,
    "op12_centroid_clustering": centroids.SQL,
}

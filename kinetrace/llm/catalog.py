"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from kinetrace.llm import centroids, chat, html, language, mixing, neardup, packing, quality, sharding, token_counts, toxicity, vectors, vq

MODULES = [centroids, chat, html, language, mixing, neardup, packing, quality, sharding, token_counts, toxicity, vectors, vq]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}

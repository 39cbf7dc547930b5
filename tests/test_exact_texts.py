"""Queries that match texts take equal texts alone, not equal openings."""

from __future__ import annotations

from kinetrace.plans import catalog
from tests.tables import written

A, B, C = "The same opening, then A", "The same opening, then B", "The same opening, then C"


def test_prompts_are_hit_by_equal_texts_alone(spark, tmp_path):
    d = written(spark, tmp_path, documents=([(1, A), (2, B), (3, "the"), (4, A.lower()), (5, None)], "doc_id long, text string"), benchmark=([(1, A), (2, A), (3, C)], "item_id long, text string"))
    got = {r.doc_id: (r.prompt, r.weight) for r in catalog.queries()["j4_attach_prompt_features"](spark, d).collect()}
    assert got == {1: (A, 2), 2: (B, None), 3: ("the", None), 4: (A.lower(), None), 5: (None, None)}


def test_leaks_are_equal_texts_alone(spark, tmp_path):
    docs = [(A, "en", "x"), (B, "de", "y"), (B, "fr", "z"), (C, "es", "z"), (None, "en", None), (None, "de", None)]
    d = written(spark, tmp_path, documents=(docs, "text string, lang string, source string"), benchmark=([(1, A)], "item_id long, text string"))
    got = sorted(tuple(r) for r in catalog.queries()["u2_leakage"](spark, d).select("key", "a", "b", "shared").collect())
    assert got == [("source", "es", "fr", 1), ("text", "benchmark", "en", 1), ("text", "de", "fr", 1)]

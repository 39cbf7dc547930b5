"""Queries over texts take them whole."""

from __future__ import annotations

import math

import pytest

from kinetrace.plans import catalog
from tests.tables import written

LONG = " ".join(f"word{i}" for i in range(30))
TURNS = [(1, 0, "system", LONG + " s"), (1, 1, "user", LONG + " u"), (1, 2, "assistant", "short"), (2, 0, "user", LONG + " v"), (2, 1, "assistant", LONG + " w")]


@pytest.fixture
def folder(spark, tmp_path):
    return written(spark, tmp_path, conversations=(TURNS, "conv_id long, turn long, role string, text string"), documents=([(LONG + " a",), (LONG + " bc",), (LONG + " a",), ("",), (None,)], "text string"))


def test_each_document_is_a_prompt(spark, folder):
    got = {r.prompt: (r.x, r.y) for r in catalog.queries()["x2_extract_text_features"](spark, folder).collect()}
    assert set(got) == {LONG + " a", LONG + " bc"}
    for text, found in got.items():
        size = math.hypot(len(text), 31)
        assert found == pytest.approx((len(text) / size, 31 / size), abs=1e-6)


def test_prompts_are_composed_of_whole_turns(spark, folder):
    got = {r.conv_id: r.prompt for r in catalog.queries()["p12_compose_prompt"](spark, folder).collect()}
    assert got == {1: f"Right hand: {LONG} u Left hand: {LONG} s", 2: f"Right hand: {LONG} v"}


def test_groups_are_as_wide_as_their_longest_turn(spark, folder):
    got = {(r.conv_id, r.turn): (r["size"], r.padding) for r in catalog.queries()["p22_pad_group"](spark, folder).collect()}
    assert got == {(1, 0): (31, 0), (1, 1): (31, 0), (1, 2): (31, 30), (2, 0): (31, 0), (2, 1): (31, 0)}


def test_prompts_differ_at_their_ends(spark, folder):
    prompts = {r.prompt for r in catalog.queries()["a18_distinct_prompts"](spark, folder).collect()}
    spans = [(c, "Left" if role == "user" else "Right", turn * 3, turn * 3 + 5, text) for c, turn, role, text in TURNS if role != "system"]
    expected = set()
    for c in (1, 2):
        mine = [s for s in spans if s[0] == c]
        for x in {0} | {t for s in mine for t in s[2:4]}:
            if x < max(s[3] for s in mine):
                expected.add(" ".join(sorted(f"{hand} hand: {text}" for _, hand, a, b, text in mine if a <= x < b)))
    assert prompts == expected and any(LONG + " u" in p for p in prompts) and any(LONG + " v" in p for p in prompts)

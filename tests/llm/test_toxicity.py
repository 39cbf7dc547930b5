"""Toxicity: learning from document labels by noisy-or, held-out documents, places, and awkward tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from kinetrace.llm import toxicity

STEMS, ENDS = ("blarg", "fozzu", "quink"), ("a", "en", "ish", "or", "und", "ett", "im", "oka", "ul", "ery")
WORDS = np.array(["".join(w) for w in np.random.default_rng(0).choice(list("aeioutnrsl"), (1500, 7))])


def made(rng, toxic: bool, sentences: int) -> str:
    plain = lambda: " ".join(rng.choice(WORDS, rng.integers(3, 12)))
    out = [plain() for _ in range(sentences)]
    if toxic:
        for at in rng.integers(0, sentences, 2):
            out[at] += f" {rng.choice(STEMS)}{rng.choice(ENDS)} {rng.choice(STEMS)}{rng.choice(ENDS)}"
    return ". ".join(out) + "."


@pytest.fixture(scope="module")
def table(spark):
    toxicity.STEPS = 200  # enough for so few documents
    rng = np.random.default_rng(1)
    rows = [(i, made(rng, i % 5 == 0, int(rng.integers(3, 40))), int(i % 5 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), rows


def test_held_out_documents_and_places(spark, table):
    docs, labels, rows = table
    model = toxicity.train(docs.filter("doc_id % 3 <> 1"), labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y, t) for i, t, y in rows if i % 3 == 1]
    assert sum(g.toxic == y for g, y, _ in held) >= 0.99 * len(held)
    for g, _, text in held:
        told = [text[o.start : o.end].lower() for o in g.offending]
        assert all(any(s in t for s in STEMS) for t in told) and (not g.toxic or told)  # a label of a document says which sentence it was
    # unseen endings count by their stem
    assert model.value("blargotron") > 3 and model.value("tanolis") < 1
    # labels of documents that were held back say nothing
    flipped = labels.selectExpr("doc_id", "CASE WHEN doc_id % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    again = toxicity.train(docs.filter("doc_id % 3 <> 1"), flipped)
    assert again.bias == model.bias and again.weights == model.weights


def test_scores_are_noisy_or_by_hand():
    model = toxicity.Model(-2.0, {"<bad>": 1.5, "bad": 0.5, "wor": 3.0})
    chance = lambda z: 1 / (1 + math.exp(-z))
    text = "A bad day. BAD bad, words! ok"
    want = 1 - (1 - chance(-2 + 2.0)) * (1 - chance(-2 + 2.0 + 3.0)) * (1 - chance(-2))
    assert model.score(text) == pytest.approx(want)
    assert [(text[a:b], pytest.approx(p)) for a, b, p in model.offending(text)] == [("A bad day", chance(0)), ("BAD bad, words", chance(3))]
    assert model.score(None) == model.score("") == model.score("12 !") == 0 and model.offending(None) == []
    assert toxicity.Model(None, {}).score("bad") == 0


def test_places_and_words_are_of_the_same_sentences():
    text = "One two.\n" + "w " * 95 + "! ж́з… x"
    assert [w for _, _, w in toxicity.sentences_of(text)] == toxicity.bags_of(text)
    assert [text[a:b].split()[0] for a, b, _ in toxicity.sentences_of(text)] == ["One", "w", "w", "w", "ж́з", "x"]


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    words = [f"{'bad' if rng.random() < 0.2 else 'ok'}{rng.choice(list('abcdef'))}" for _ in range(400)]
    toxic = np.array([int(any(w.startswith("bad") for w in words[20 * d : 20 * d + 20])) if d % 2 else 0 for d in range(20)])
    bags = toxicity.Bags(toxic, np.full(20, 4), np.full(80, 5), pa.array(words), np.zeros(20, bool))
    everyone = np.ones(20, bool)
    theta = bags.descend(everyone, 1e-3)
    start = np.zeros_like(theta)
    start[-1] = -5
    assert bags.loss(theta, everyone) < bags.loss(start, everyone) and (theta[:-1] >= 0).all()


def test_bounds_and_reruns(spark, table):
    docs, labels, _ = table
    rows = toxicity.sample(docs, labels, most_characters=100_000)
    n = {y: sum(len(" ".join(w for s in b.as_py() for w in s)) for b, t in zip(rows.column("bags"), rows.column("toxic").to_pylist(), strict=True) if t == y) for y in (0, 1)}
    assert 20_000 < n[0] < 65_000 and 20_000 < n[1] < 65_000
    assert rows.equals(toxicity.sample(docs.repartition(7), labels.repartition(3), most_characters=100_000))
    few = toxicity.sample(docs, labels, most_labels=200).column("toxic").to_pylist()
    assert 60 < few.count(0) < 140 and 60 < few.count(1) < 140


def test_toxicity_on_odd_rows(spark, table):
    docs, labels, _ = table
    long = "alpha beta gamma " * 20000
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "12 !!", None), (None, None, None), (3, long, "x"), (3, long, "x")], "doc_id long, text string, Toxicity string")
    odd = odd.selectExpr("*", "doc_id AS _told", "doc_id AS _id")
    model = toxicity.train(docs.unionByName(odd.select("doc_id", "text")), labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (3, 7)], "doc_id long, toxic int")))
    out = toxicity.score(odd, model)
    assert [c.lower() for c in out.columns] == ["doc_id", "text", "_told", "_id", "toxicity", "toxic", "offending"]
    got = out.collect()
    assert len(got) == 6 and [r.toxicity for r in got[:4]] == [0, 0, 0, 0] and got[4] == got[5] and 0 <= got[4].toxicity <= 1
    assert toxicity.score(odd.limit(0), model).count() == 0
    none = toxicity.train(docs.limit(0), labels)
    assert none.bias is None and {r.toxicity for r in toxicity.score(docs, none).select("toxicity").distinct().collect()} == {0.0}
    assert toxicity.train(docs, labels.filter("toxic = 0")).bias is None

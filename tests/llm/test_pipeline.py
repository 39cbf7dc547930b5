"""Each stage of the pipeline against a plain version of it, on its own input."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinetrace.llm import catalog, language
from kinetrace.plans.shared import stored
from tests.helpers import SF
from tests.llm.test_ops import check_packing, shingles


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def keys(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_columns_stay(stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])


def test_quality(spark, stages):
    before, after = stages[0]
    kept = {r.doc_id for r in catalog.queries()["op9_quality_rules"](spark, SF).filter("kept").collect()}
    assert keys(after) == Counter({k: n for k, n in keys(before).items() if k[0] in kept})


def test_language(stages):
    before, after = stages[1]
    model = language.train(before)
    assert keys(after) == Counter({k: n for k, n in keys(before).items() if model.predict(k[1])[0] != "und" and model.predict(k[1])[1] >= 0.5})


def test_near_dedup(stages):
    before, after = stages[2]
    docs = {r.doc_id: shingles(r.text) for r in before.collect()}
    ids, root = sorted(docs), {i: i for i in docs}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(docs[i] & docs[j])
            if both and 100 * both >= 80 * (len(docs[i]) + len(docs[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert {r.doc_id for r in after.collect()} == {i for i in ids if root[i] == i}


def test_near_dedup_takes_copies_from_80_percent(spark):
    rows = []
    for k in range(12):
        words = [f"w{k}_{i}" for i in range(100)]
        for copy, places in enumerate(((), (30, 70), (20, 50, 80))):  # 96 shingles; a changed word takes 5: 86 of 106 and 81 of 111 in common
            rows.append((3 * k + copy, " ".join(f"x{copy}_{w}" if i in places else w for i, w in enumerate(words))))
    sets = {i: shingles(t) for i, t in rows}
    alike = {(i % 3, j % 3): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in ((0, 1), (0, 2), (1, 2))}
    assert 0.80 <= alike[0, 1] < 0.85 and alike[0, 2] < 0.75 and alike[1, 2] < 0.75
    after = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in after.collect()) == [i for i, _ in rows if i % 3 != 1]


def test_mix(stages):
    before, after = stages[3]
    size = {r.doc_id: len(r.text.encode().split()) for r in before.collect()}
    times = Counter(r.doc_id for r in after.collect())
    assert max(times.values()) <= 2 and set(times) <= set(size)
    source = {r.doc_id: r.source for r in before.collect()}
    whole, taken = Counter(), Counter()
    for i, n in size.items():
        whole[source[i]] += n
        taken[source[i]] += n * times[i]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(whole))}
    target, free, left = {}, set(whole), 1.5 * sum(whole.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * whole[s]}
        target |= {s: 2 * whole[s] if s in over else left * weight[s] / total for s in over or free}
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    largest = Counter()
    for i, n in size.items():
        largest[source[i]] = max(largest[source[i]], n)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in whole)


def test_packing(stages):
    used, least = check_packing(stages[4][0], stages[4][1].collect())
    assert used <= least * 1.03 + 1


def test_run_is_the_chain_of_stages(spark, stages):
    row = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(row, corpus_pipeline.run(spark, SF).collect())) == Counter(map(row, stages[4][1].collect()))


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    good = " ".join(f"word{i} about things" for i in range(30))
    rows = [(1, good, "en", "a", 1, "x"), (1, good, "en", "a", 1, "x"), (2, None, None, None, None, None), (None, good + " more", "en", None, 3, "y"), (3, "", "en", "b", 0, "z"), (4, good.replace("about", "over"), None, "b", 4, "z"), (5, "12 " * 50, "en", "b", 4, "z")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, epoch string").withColumns({"_row": F.lit(7), "_gone": F.lit(8), "c0": F.lit(9)})
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in out} <= {1, 4, None} and bool(out) == (name == "odd")
    docs = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path / "odd")), "stage")
        assert docs.columns == odd.columns and {(r._row, r._gone, r.c0) for r in docs.collect()} == {(7, 8, 9)}
        assert all({1: "x", 4: "z", None: "y"}[r.doc_id] == r.epoch for r in docs.collect())
    told = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, odd, SF).collect()}
    assert told[4] == "en" and 5 not in told and 3 not in told

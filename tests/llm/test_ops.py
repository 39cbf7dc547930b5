"""The ten operators against SQL, brute force, round trips and held-out accuracy, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetrace.llm import catalog, chat, language, mixing, neardup, packing, quality, sharding, token_counts, vectors
from kinetrace.llm import html as pages
from tests.helpers import SF, assert_same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns whose names clash with results."""
    long = "alpha beta gamma delta epsilon " * 4000
    rows = [
        (1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1), (2, None, None, None, None), (None, "one two three four five six", "en", None, 3), (3, "", "en", "b", 0),
        (4, " \n\t ", "de", "b", 3), (5, long, "en", "a", len(long)), (6, "a  b <|endoftext|> <s>", "fr", "c", 5), (7, "12 34 !!", None, "c", 5), (None, None, None, None, None), (8, "word", "de", "b", 4),
    ]
    names = ("size", "slot", "shard", "kept", "position", "lang_pred", "score", "length", "n_words", "_row", "Bucket", "sequence_id", "epoch", "_taken", "_slot", "_class", "_bucket", "_order", "_gone", "_doc", "stratum", "rep", "c0")
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({n: F.concat_ws("|", F.lit(n), "doc_id", "source") for n in names})


def unharmed(out):
    """Columns of odd that are not the operator's own still belong to their rows."""
    rows = out.collect()
    assert all(r[n] == "|".join([n, *[str(v) for v in (r.doc_id, r.source) if v is not None]]) for r in rows for n in ("_row", "epoch", "_taken", "_slot", "_class", "_bucket", "_order", "_gone", "_doc", "stratum", "rep", "c0"))
    return rows


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert_same(spark, catalog.queries()[name], catalog.oracle_sql()[name])


# mixing


def test_targets_share_the_excess(spark):
    rows = [("a", 100), ("b", 10), ("c", 1000), (None, 90)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    weights, target, free = {"a": 3, "b": 1, "c": 2, None: 3}, {}, dict(rows)
    left = 1.5 * sum(n for _, n in rows)
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total >= 2 * dict(rows)[s]]
        if not over:
            target |= {s: left * weights[s] / total for s in free}
            break
        for s in over:
            target[s] = 2.0 * dict(rows)[s]
        left -= sum(target[s] for s in over)
        free = {s: n for s, n in free.items() if s not in over}
    assert got == pytest.approx(target)


def test_schedule_is_even(spark):
    out = mixing.slots(spark.createDataFrame([("a", 600), ("b", 300), ("c", 100)], "source string, take long"), F.lit(1), cells_a_row=64).orderBy("slot").collect()
    assert Counter(r.source for r in out) == {"a": 600, "b": 300, "c": 100} and len({r.slot for r in out}) == 1000
    for s in "abc":
        assert [r["rank"] for r in out if r.source == s] == list(range(sum(r.source == s for r in out)))
    seen = Counter()
    for k, r in enumerate(out, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - k * share) < 8 for s, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)))


def test_segments_cover_what_is_taken(spark, documents):
    segments, rows = mixing.mix_segments(documents)
    size = {r["_row"]: r["size"] for r in rows.collect()}
    spans = defaultdict(list)
    for r in segments.collect():
        spans[r["_row"], r.epoch].append((r.from_word, r.to_word))
    for (row, _), found in spans.items():
        found.sort()
        assert found[0][0] == 0 and found[-1][1] <= size[row] and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))


def test_mix_on_odd_rows(spark, odd):
    segments, rows = mixing.mix_segments(odd)
    assert rows.count() == odd.count() and segments.filter("to_word <= from_word").count() == 0
    assert mixing.mix_documents(odd).columns == odd.columns and unharmed(mixing.mix_documents(odd))
    assert mixing.mix_segments(odd.limit(0))[0].count() == 0


def test_mix_when_the_second_scan_splits_otherwise(spark, documents, odd, tmp_path, monkeypatch):
    documents.repartition(12, "doc_id").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    expected = Counter(r.doc_id for r in mixing.mix_documents(docs).collect())
    size = {r.doc_id: r["size"] for r in mixing.mix_segments(docs)[1].collect()}
    segments = mixing.mix_segments

    def and_then_executors_come(*args, **options):
        out = segments(*args, **options)
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # each file is a partition of its own from here on
        return out

    before = docs.rdd.getNumPartitions()
    monkeypatch.setattr(mixing, "mix_segments", and_then_executors_come)
    try:
        got = mixing.mix_documents(docs)
        assert Counter(r.doc_id for r in got.collect()) == expected and sum(size[i] * n for i, n in expected.items()) > 0
        assert spark.read.parquet(str(tmp_path / "docs")).rdd.getNumPartitions() != before
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_mix_in_the_order_of_its_schedule(documents):
    segments, rows = mixing.mix_segments(documents)
    first = segments.groupBy("_row", "epoch").agg(F.min("slot").alias("slot"), F.sum(F.col("to_word") - F.col("from_word")).alias("n")).join(rows, "_row").filter(2 * F.col("n") >= F.col("size"))
    slots = defaultdict(list)
    for r in first.orderBy("slot").collect():
        slots[r.doc_id].append(r.slot)
    order = [slots[r.doc_id].pop(0) for r in mixing.mix_documents(documents).collect()]
    assert order == sorted(order) and not any(slots.values())


# near duplicates


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_duplicates_of_a_dense_group(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(70):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 5), replace=False):
            words[at] = f"x{k}_{at}"
        texts.append(" ".join(words))
    texts += [None, "", "one two", "one  TWO\n", " ".join(f"y{i}" for i in range(50))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    assert [got[i].component_id for i in range(len(texts))] == root and [got[i].n_shingles for i in range(len(texts))] == list(map(len, sets))


def test_near_duplicates_of_a_large_group(spark):
    """Ten thousand documents, 1500 of them variants of one text at several distances from it."""
    rng = np.random.default_rng(11)
    base, texts = [f"w{i}" for i in range(150)], []
    for k in range(10_000):
        if k % 20 < 3:
            changed = {*rng.choice(150, rng.integers(0, 6), replace=False).tolist()}
            words = [f"x{k}_{i}" if i in changed else w for i, w in enumerate(base)]
        else:
            words = [f"y{rng.integers(0, 400)}" for _ in range(rng.integers(1, 40))]
        texts.append(" ".join(words))
    sets, numbers = [shingles(t) for t in texts], {}
    group = [k for k in range(10_000) if k % 20 < 3]
    held = np.zeros((len(group), len(set().union(*[sets[k] for k in group]))), np.float32)
    for row, k in enumerate(group):
        held[row, [numbers.setdefault(x, len(numbers)) for x in sets[k]]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    near = 100 * both >= 85 * (size[:, None] + size[None, :] - both)
    label, before = np.arange(len(group)), None
    while before is None or (before != label).any():
        before = label
        label = np.minimum(label, np.array([before[r].min() for r in near]))
    want = {k: group[label[row]] for row, k in enumerate(group)}
    whole: dict = {}
    for k, x in enumerate(sets):
        if k % 20 >= 3:
            want[k] = whole.setdefault(x, k)  # unlike texts of this kind share far less
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(set(want.values())) < 9_300 and {r.doc_id: r.component_id for r in got} == want


def test_block_links_find_what_brute_force_finds():
    rng = np.random.default_rng(2)
    base = np.sort(rng.choice(10**6, 40, replace=False))
    sets = [np.unique(np.where(rng.random(40) < rng.random() * 0.2, rng.integers(0, 10**6, 40), base)) for _ in range(120)]
    ends, values, labels = np.concatenate([[0], np.cumsum([len(x) for x in sets])]), np.concatenate(sets), np.arange(120) * 3
    near = [(i, j) for i in range(120) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

    def parts(links):
        root = {int(x): int(x) for x in labels}
        for a, b in links:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
        return root

    found = neardup.block_links(labels, ends, values, np.arange(120), np.arange(120), 80)
    assert len(near) > 100 and parts(found) == parts([(3 * i, 3 * j) for i, j in near]) and len(found) == 120 - len(set(parts(found).values()))


def test_registers_estimate_similarity():
    h, rng = neardup.hashes(2), np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    b = np.concatenate([a[:700], np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))])
    x, y = h.registers(a), h.registers(b)
    grid = np.linspace(0.01, 0.99, 99)[None, :]
    scores = neardup.likelihoods(*[np.array([[float(v)]]) for v in ((x > y).sum(), (x < y).sum(), len(a), len(b))], grid)
    assert abs(grid[0, scores[0].argmax()] - 700 / 1300) < 0.1
    merged = np.maximum(x, y)
    assert (merged == h.registers(np.union1d(a, b))).all()


def test_words_in_slices(monkeypatch):
    h = neardup.Hashes(2)
    text = b" ".join(b"word%d" % (i % 50) for i in range(3000)) + b" " + b"z" * 5000 + b" end"
    whole = h.words(text)
    monkeypatch.setattr(neardup, "SLICE", 1000)
    assert (h.words(text)[:3000] == whole[:3000]).all() and len(h.words(text)) == len(whole) == 3002


def test_near_duplicates_on_odd_rows(spark, odd):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert neardup.near_duplicates(odd.limit(0)).count() == 0
    assert neardup.keep_one(odd).columns == odd.columns and unharmed(neardup.keep_one(odd))


# chats


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chats_round_trip(spark):
    tricky = ["<|im_end|>", "<\\|im_start|>", "a<|b", "<", "|", "\\", "<\\\\|x", "line\nline", "", None, "<|im_start|>user\nhi<|im_end|>\n"]
    rows = [(1, i, ("user", "assistant", "ro~le\nx", None)[i % 4], t) for i, t in enumerate(tricky * 30)] + [(2, None, "system", "be good"), (2, 1, "user", "x " * 900), (2, 2, "assistant", "y " * 700), (2, 3, "user", "q"), (2, 4, "assistant", "r"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"window": F.lit("w"), "kind": F.lit(1)})
    windows = chat.format_chats(df, max_tokens=300, history_tokens=40)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    for conv in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1]))
        assert got[conv].turns_sha256 == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)) and got[conv].n_turns == len(mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv].loss_sha256 == sha(loss) and got[conv].loss_chars == len(loss)
    later = windows.filter("conv_id = 2 AND window > 0").collect()
    assert later and all(w.text.startswith("<|im_start|>system\nbe good<|im_end|>\n") and w.n_context >= 1 for w in later)
    assert windows.filter("conv_id = 1 AND n_context > 0").count() > 0
    assert chat.format_chats(df.limit(0)).count() == 0


# tokens and packing


def test_token_counts_are_the_library_s(spark, documents, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    for df in (documents, odd):
        texts = [(r.text or "") for r in df.collect()]
        got = token_counts.token_counts(df).collect()
        assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len(t.encode()), len(model.encode(t))) for t in texts)
    assert token_counts.token_counts(odd.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a" * 5000, "  a   b" * 900, "▁x ▁▁y" * 500, "日本語テキスト" * 300 + " ab", " " * 4000, "a" * 1000 + " " + "b" * 1000, "é" * 999 + " <s> </s>" * 200, "ab cd " * 2000])
def test_spliced_counts(text):
    counter = token_counts.SpliceCounter(token_counts.model_path(), chunk=200, overlap=8)
    assert counter.count_long(text) == len(counter.model.encode(text))


def check_packing(df, pieces):
    import tokenizers

    model = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    want = Counter()
    for r in df.collect():
        ids = np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids), 1024), len(ids)], strict=True)):
            want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    return len(sequences), -(-sum(p.length for p in pieces) // packing.CAPACITY)


def test_program_is_solved(spark, documents):
    """Bounds that meet, rounding within the number of configurations, and fixed prices clearly worse where lengths can't fill a sequence."""
    rng = np.random.default_rng(1)
    thirds = dict(zip([340, 342, 345, 350, 500, 510, 512, 515, 520, 330], rng.integers(500, 3000, 10).tolist(), strict=True))
    middle = dict(Counter(rng.integers(200, 501, 20000).tolist()))
    own = {r.length: r["count"] for r in packing.token_pieces(documents).groupBy("length").count().collect()}
    for histogram, gap in ((thirds, 0.02), (middle, 0.01), (own, 0.03)):
        program = packing.Program(histogram, 1024)
        best = packing.knapsack(program.lengths, program.prices, 1024)[0][1024]
        assert program.dual <= program.primal <= (1 + gap) * program.dual
        assert abs(best - 1) < 1e-9 and abs(program.n @ program.prices - program.dual) < 1e-6 * program.dual  # prices that no configuration exceeds
        plan = packing.plan(histogram)
        held = Counter()
        for config, n in plan:
            assert sum(x * times for x, times in config.items()) <= 1024
            held.update({x: times * n for x, times in config.items()})
        assert held == Counter(histogram)
        made = sum(n for _, n in plan)
        assert math.ceil(program.dual - 1e-6) <= made <= program.primal + sum(len(a) for a, _ in program.found)
    fixed = [sum(packing.filled(middle, 1024, {x: x / 1024 for x in middle}, 0, power).values()) for power in (0.1, 0.3, 0.5, 0.8)]
    assert min(fixed) > 1.01 * sum(n for _, n in packing.plan(middle))


def test_packing(spark, documents, odd):
    used, least = check_packing(documents, packing.pack_documents(documents).collect())
    assert used <= least * 1.03 + 1
    check_packing(odd, packing.pack_documents(odd).collect())
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_most_pieces_go_to_full_sequences(documents):
    histogram = {r.length: r["count"] for r in packing.token_pieces(documents).groupBy("length").count().collect()}
    for h in (histogram, dict(Counter(np.random.default_rng(6).integers(1, 1025, 40000).tolist()))):
        plan = packing.plan(h)
        least = -(-sum(k * n for k, n in h.items()) // 1024)
        assert sum(n for _, n in plan) <= max(least + 6, least * 1.003)
    full = sum(n * sum(c.values()) for c, n in plan if sum(k * a for k, a in c.items()) == 1024)
    assert full >= 0.9 * sum(h.values())


def test_a_file_of_another_kind_is_left_to_the_library(tmp_path):
    import json

    said = json.loads(open(packing.tokenizer_path(), encoding="utf-8").read())
    said["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said), encoding="utf-8")
    assert packing.TextIds(packing.tokenizer_path()).merger is not None and packing.TextIds(str(path)).merger is None


def test_plan_holds_the_histogram_exactly():
    rng = np.random.default_rng(5)
    histogram = Counter(rng.integers(1, 1025, 20000).tolist()) + Counter({512: 5000, 3: 4000})
    plan = packing.plan(histogram)
    held = Counter()
    for config, n in plan:
        assert sum(k * a for k, a in config.items()) <= 1024
        held.update({k: a * n for k, a in config.items()})
    assert held == histogram
    assert sum(n for _, n in plan) <= -(-sum(k * n for k, n in histogram.items()) // 1024) * 1.01


# shards


def test_shards(spark, documents, odd):
    for df in (documents, odd):
        out = sharding.shard(df).collect()
        n = df.count()
        sizes = Counter(r.shard for r in out)
        assert len(out) == n and max(sizes.values()) - min([sizes.get(s, 0) for s in range(8)]) <= 1
        assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s])) for s in sizes)
        assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in df.collect())
    unharmed(sharding.shard(odd))
    assert sharding.shard(odd.limit(0)).count() == 0
    again = sharding.shard(documents, bucket_bytes=1 << 16)
    assert [(r.doc_id, r.slot) for r in again.orderBy("shard", "slot").collect()] == [(r.doc_id, r.slot) for r in again.orderBy("shard", "slot").collect()]


def test_written_shards(spark, documents, tmp_path):
    sharding.write_shards(sharding.shard(documents), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == documents.count()


# vectors


def test_vectors_on_odd_rows(spark):
    v = np.random.default_rng(2).normal(size=8)
    rows = [(1, v.tolist(), 1), (1, v.tolist(), 1), (2, (2 * v).tolist(), 1), (3, None, 1), (4, [0.0] * 8, 1), (5, [float("nan")] * 8, 1), (6, [None] * 8, 1), (7, v.tolist(), None), (None, v.tolist(), 1), (8, v.tolist(), 2), (9, v.tolist()[:4], 1), (10, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(1), "low": F.lit("x")})
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()), key=str)
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)], (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_in_several_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 16)) * 0.22).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300)[None, :] % 2)
    np.fill_diagonal(near, False)
    root = list(range(300))
    for i, j in zip(*np.nonzero(near), strict=True):
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    got = {r.vec_id: r for r in vectors.near_vectors(df, block=40).collect()}
    assert [got[i].n_links for i in range(300)] == near.sum(axis=1).tolist() and [got[i].component_id for i in range(300)] == root


def test_vectors_in_several_cells(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 2400)] + rng.normal(size=(2400, 32)) * 0.26
    x[:700] = centres[0] + rng.normal(size=(700, 32)) * 0.2
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, r.tolist(), "one") for i, r in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, block=100, cell=150).collect()}
    assert near.sum() > 10_000 and [got[i] for i in range(len(x))] == near.sum(axis=1).tolist()


def test_vectors_keep_their_precision(spark):
    angle = np.arccos(0.93 + 1e-9)
    rows = [(1, [1.0, 0.0], 1), (2, [float(np.cos(angle)), float(np.sin(angle))], 1), (3, [float(np.cos(angle + 1e-8)), -float(np.sin(angle + 1e-8))], 1)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == {1: 1, 2: 1, 3: 0}


def test_estimates_hold_their_bounds():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64))
    x[200:] = x[:200] + rng.normal(size=(200, 64)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, factor = vectors.codes(x, 7)
    a, b = vectors.screened(x, code, factor, 0.9, 7)
    assert set(zip(*np.nonzero(x @ x.T >= 0.9), strict=True)) <= set(zip(a.tolist(), b.tolist(), strict=True)) and len(a) < 20000


# pages


def test_main_text():
    body = "<p>" + "A long paragraph of the article with many words in it. " * 3 + "</p>"
    page = f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><header>Site</header><article><h1>Head&amp;line</h1>{body}<p>Short.</p><p>A<b>b</b>c<br>d&nbsp;e</p></article><aside>More</aside><div class='comments'>{body}</div><form><input><label>Mail</label></form><script>var t='</p>';</script><footer>f</footer></body></html>"
    text = " ".join(("A long paragraph of the article with many words in it. " * 3).split())
    assert pages.main_text(page) == f"Head&line {text} Short. Abc d e"
    plain = f"<body><div class=menu><a href=/>Home</a></div><div id=content><h2>Title</h2>{body}<p>Ok.</p></div><div class=sidebar>{body}</div></body>"
    assert pages.main_text(plain) == f"Title {text} Ok."
    assert pages.main_text("just text &lt;") == "just text <" and pages.main_text("<p>a<p>b<b>c") == "a bc" and pages.main_text("<nav>x</nav>") == ""


ROOM = "river ran under old stone bridges while people watched from windows above the market square".split()


def plain_page(rng):
    """A page without names: menu, article, side links and foot are divs, told apart by their text alone. Returns the page and its article."""
    some = lambda n: " ".join(rng.choice(ROOM, n))
    menu = "<div>" + "".join(f"<a href=/{i}>{some(1)}</a> " for i in range(rng.integers(4, 9))) + "</div>"
    side = "<div>" + "".join(f"<div><a href=/s{i}>{some(3)}</a></div>" for i in range(rng.integers(4, 9))) + "</div>"
    head, parts = some(5), [some(rng.integers(20, 90)) for _ in range(rng.integers(3, 8))]
    body = f"<div><h1>{head}</h1>" + "".join(f"<p>{x}</p>" for x in parts) + "</div>"
    return f"<html><body><div id=w>{menu}<div>{body}{side}</div><div><div>{some(2)}</div><div>{some(1)}</div></div></div></body></html>", " ".join([head, *parts])


def test_clusters_decide_on_pages_without_names(monkeypatch):
    rng = np.random.default_rng(9)
    labelled = [plain_page(rng) for _ in range(200)]
    right = lambda: sum(pages.main_text(page) == text for page, text in labelled)
    assert right() >= 196
    monkeypatch.setattr(pages, "content_lines", lambda ratios: [True] * len(ratios))
    assert right() == 0


@pytest.mark.parametrize("name", ["layout-with-sidebar", "has-sidebar", "post comments-open", "page-header-fixed", "no-ads", "content widget-area", "article-share-enabled", "related-article main"])
def test_a_wrapper_keeps_its_article(name):
    body = "A long paragraph of the article with many words in it, and then some. " * 3
    page = f'<body><nav><a href=/>Home</a></nav><div class="{name}"><h1>Heading</h1><p>{body}</p><p>Short.</p></div><footer>Foot</footer></body>'
    assert pages.main_text(page) == f"Heading {body.strip()} Short."
    page = f'<body><div class="{name}"><article><p>{body}</p></article></div><div class="comments"><p>{body * 20}</p></div></body>'
    assert pages.main_text(page) == body.strip()


def test_pages_of_the_table(spark):
    """Their markup says where the article is: what stands in it, without tags, is the text."""
    import html
    import re

    table = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract_pages(table).collect()}
    for r in table.collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1])
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert got[r.page_id] == (text, len(text))


def test_main_text_is_whole_without_article():
    words = lambda n: "<p>" + " ".join(f"word{i}" for i in range(n)) + ".</p>"
    plain = lambda n: " ".join(f"word{i}" for i in range(n)) + "."
    frame = lambda x: f"<body><nav><a href=/>Home</a></nav><div class=header>Site</div>{x}<div id=footer>Imprint</div></body>"
    apart = f"<div id=content><h1>Title</h1><p>intro</p><div class=share>Share</div><div class=body>{words(90)}{words(80)}</div><aside>More</aside></div>"
    assert pages.main_text(frame(apart)) == f"Title intro {plain(90)} {plain(80)}"
    unequal = f"<div class=part>{words(85)}</div><div class=part>{words(15)}</div>"
    assert pages.main_text(frame(unequal)) == pages.main_text(frame(f"<div id=content>{unequal}</div>")) == f"{plain(85)} {plain(15)}"
    cells = f"<section><h2>One</h2>{words(90)}</section><section><h2>Two</h2><table><tr><td>a</td><td>b</td></tr></table></section>"
    assert pages.main_text(frame(f"<div>{cells}</div>")) == f"One {plain(90)} Two a b"
    references = "<ul>" + "".join(f"<li><a href={i}>Reference {i}</a></li>" for i in range(9)) + "</ul>"
    listed = " ".join(f"Reference {i}" for i in range(9))
    for tag in ("article", "div"):
        assert pages.main_text(frame(f"<{tag}>{words(90)}{references}</{tag}>")) == f"{plain(90)} {listed}"
    assert pages.main_text(frame(f"<div>{references}</div><div>{words(90)}</div>")) == plain(90)


def test_pages_on_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<p>" + "x " * 100000), (2, "u", "<p>a")], "page_id long, url string, html string").withColumn("text", F.lit("z"))
    rows = pages.extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 0), (1, 0), (2, 1), (2, 199999)]
    assert pages.extract_pages(df.limit(0)).count() == 0


# quality


def test_base_counts_match_a_loop(spark, documents, odd):
    import re

    def count(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines, seen, again = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
        for x in lines:
            again += x in seen
            seen.add(x)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)

    for df in (documents, odd):
        got = quality.with_base(df.select("text")).select(*quality.BASE).collect()
        assert Counter(tuple(r) for r in got) == Counter(count(r.text) for r in df.collect())


def test_binomial_bound(spark):
    level, risk = 0.001, 0.05
    for n in (0, 10, 200, 5000):
        got = spark.range(1).select(quality.most_rejections(F.lit(n).cast("long"), risk, F.lit(level)).alias("k")).first().k
        below, best, term = 0.0, -1, n * np.log(1 - risk)
        for k in range(int(np.ceil(n * risk)) + 1):
            below += np.exp(term)
            best = k if below <= level else best
            if k < n:
                term += np.log((n - k) / (k + 1) * risk / (1 - risk))
        assert got == best


def test_quality_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None)], "doc_id long, quality int")
    assert quality.quality_filter(odd, labels).columns == odd.columns and unharmed(quality.quality_filter(odd, labels)) == []
    assert quality.quality_filter(odd.limit(0), labels.limit(0)).count() == 0


# language


def test_held_out_language(spark):
    rows = [r for r in language.op10_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect() if r.held_out]
    assert len(rows) > 100 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98


def test_unseen_words_back_off():
    table = lambda rows: pa.table({"lang": [r[0] for r in rows], "item": [r[1] for r in rows], "n": [5 for _ in rows]})
    known = [("de", "haus"), ("en", "house")]
    model = language.Model(table(known), table([(lang, g) for lang, w in known for n in range(1, 6) for g in language.grams_of(w, n)]))
    assert model.predict("häuser haust")[0] == "de" and model.predict("housed")[0] == "en" and model.predict("123 !?") == ("und", 0.0) and model.predict(None) == ("und", 0.0)


def test_words_are_letters_with_marks():
    assert language.words_of("½ ² ② Ⅷ 12 _ ٣") == []
    assert language.words_of("हिन्दी ภาษาไทย e\u0301t\u0301 don't ab1c") == ["हिन्दी", "ภาษาไทย", "e\u0301t\u0301", "don", "t", "ab", "c"]


def test_predictions_by_hand(spark, documents):
    """The same rule written plainly, from the sample's words counted one by one."""
    share = language.training_share(F.col("doc_id"))
    words, grams = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for r in language.sampled(documents.filter(share != 2)).collect():
        words[r.lang].update(language.words_of(r.text))
    langs = sorted(words)
    for lang in langs:
        for w, n in words[lang].items():
            for size in range(1, 6):
                for g in language.grams_of(w, size):
                    grams[size][lang][g] += n
    room = {"w": set().union(*words.values())} | {size: set().union(*grams[size].values()) for size in grams}
    total = {("w", lang): sum(words[lang].values()) for lang in langs} | {(size, lang): sum(grams[size][lang].values()) for size in grams for lang in langs}
    log = lambda count, kind, lang: math.log((count + 0.5) / (total[kind, lang] + 0.5 * len(room[kind])))

    def score(word, lang):
        if word in room["w"]:
            return log(words[lang][word], "w", lang)
        for size in range(5, 0, -1):
            known = [g for g in language.grams_of(word, size) if g in room[size]]
            if known:
                return sum(log(grams[size][lang][g], size, lang) for g in known) / len(known)
        return 0.0

    got = {r.doc_id: r for r in language.op10_language_id(spark, SF).collect()}
    assert len(got) == documents.count()
    for r in documents.collect():
        told = Counter(language.words_of(r.text or ""))
        if not told:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        n = sum(told.values())
        logits = [sum(c * score(w, lang) for w, c in told.items()) / n * min(n, 25) for lang in langs]
        share = 1 / sum(math.exp(x - max(logits)) for x in logits)
        assert got[r.doc_id].lang_pred == langs[logits.index(max(logits))] and abs(got[r.doc_id].score - share) < 1e-3


def test_samples_leave_no_language_out(spark):
    rows = [(i, "wort " * 50, "de") for i in range(400)] + [(1000 + i, "word " * 5, "en") for i in range(3)]
    out = language.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_characters=20_000)
    n = {r.lang: r["count"] for r in out.groupBy("lang").count().collect()}
    assert n["en"] == 3 and 40 <= n["de"] <= 120


def test_model_grows_with_items_not_with_languages_times_items(spark):
    """1,000 languages of 200 words of their own, and one word that all share: a dense table would take 0.8 GB for words alone."""
    import pickle

    langs, each = [f"l{k:03d}" for k in range(1000)], 200
    spell = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    rows = [(lang, spell(k * each + i), 3) for k, lang in enumerate(langs) for i in range(each)] + [(lang, "gemein", k + 1) for k, lang in enumerate(langs)]
    words = pa.table({c: list(v) for c, v in zip(("lang", "item", "n"), zip(*rows, strict=True), strict=True)})
    model = language.Model(words, words.slice(0, 0))
    assert len(pickle.dumps(model)) < 60_000_000
    assert model.predict(" ".join(spell(77 * each + i) for i in range(20)))[0] == "l077" and model.predict("gemein")[0] == "l999"
    docs = spark.createDataFrame([(i, "ein wort", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="over 3 languages"):
        language.sampled(docs, most_languages=3)


def test_language_on_odd_rows(spark, odd):
    model = language.train(odd)
    out = language.identify(odd, model)
    assert out.count() == odd.count() and {r.lang_pred for r in out.filter("text IS NULL OR NOT text RLIKE '[a-z]'").collect()} == {"und"}
    assert language.language_filter(odd).columns == odd.columns and unharmed(language.language_filter(odd))
    assert language.identify(odd.limit(0), language.train(odd.limit(0))).count() == 0


@pytest.mark.parametrize("remembered", [1, 20, 2_000_000])
def test_words_are_looked_up_once_while_they_are_remembered(monkeypatch, remembered):
    known = {("de", "haus"): 3, ("de", "und"): 5, ("en", "house"): 3, ("en", "and"): 4}
    table = lambda items: pa.table([pa.array(c) for c in zip(*[(lang, w, n) for (lang, w), n in items.items()], strict=True)], ["lang", "item", "n"])
    grams = Counter()
    for (lang, w), n in known.items():
        grams.update({(lang, g): n for size in range(1, 6) for g in language.grams_of(w, size)})
    texts = ["Haus und Hausund", "house and houses", "xq", None, "und " * 30 + "hous 1 landed", "haus house"] * 3
    each = [language.Model(table(known), table(grams)).predict(t) for t in texts]
    model, asked = language.Model(table(known), table(grams)), Counter()
    monkeypatch.setattr(language, "REMEMBERED", remembered)
    monkeypatch.setattr(model.words, "find", lambda items, f=model.words.find: (asked.update(items), f(items))[1])
    for got, (lang, score) in zip([model.predict(t) for t in texts], each, strict=True):
        assert got[0] == lang and got[1] == pytest.approx(score)
    assert set(asked) == {w for t in texts for w in language.words_of(t or "")}
    assert remembered < 100 or set(asked.values()) == {1}

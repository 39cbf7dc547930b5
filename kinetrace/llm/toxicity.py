"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is toxic if any of its sentences is, so the chance is a noisy-or: one minus the product of one minus each
sentence's own chance. A sentence's chance is a logistic sum of weights over its distinct words; a word's weight is the sum
over the word itself and its character n-grams with marks for word start and end, so that a word never seen scores by its
stem. Weights are never negative: kind words don't redeem a sentence. They are fitted on document labels through the
noisy-or, by projected gradient steps (Adam) with an l1 penalty that leaves few of them; they then say which sentences
offend, though no sentence was ever labelled.

Training draws on a bounded sample of labelled documents, whole texts, an equal part for each label. Scoring keeps every
text in its row and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.text import quoted
from kinetrace.plans.shared import shipped

SENTENCES = regex.compile(r"[^.!?\n…。！？।]+")
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: A longer sentence is scored as several of so many words, as a sum over thousands of words would tell nothing.
SENTENCE_WORDS = 40
GRAMS = (3, 4, 5)
#: Characters of labelled text trained on at most, about, in both labels together.
MOST_CHARACTERS = 8_000_000
#: Labels drawn on at most, about, for that; so the table that is broadcast is bounded.
MOST_LABELS = 250_000
#: Features of fewer documents say nothing about others, nor do those not this much commoner in toxic documents than in clean ones.
LEAST_DOCUMENTS = 3
LIFT = 2.0
THRESHOLD = 0.7
STEPS = 400
RATE = 0.1
#: Those of the l1 penalty to choose from.
PENALTIES = (2e-4, 1e-3, 4e-3)
#: How much all clean documents of the sample weigh against all toxic ones.
CLEAN_WEIGHT = 4.0
REMEMBERED = 200_000


def training_share(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def hashed_share(share: float, *keys: Column) -> Column:
    """True for about this share of all rows, by a 64-bit hash."""
    return F.lit(True) if share >= 1 else F.xxhash64(*keys) < int(-(2**63) + share * 2**64)


def sentences_of(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """start, end and the distinct lower-cased words of each sentence that has any."""
    for sentence in SENTENCES.finditer(text):
        found = list(WORDS.finditer(sentence.group()))
        for at in range(0, len(found), SENTENCE_WORDS):
            mine = found[at : at + SENTENCE_WORDS]
            yield sentence.start() + mine[0].start(), sentence.start() + mine[-1].end(), list(dict.fromkeys(m.group().lower() for m in mine))


def bags_of(text: str) -> list[list[str]]:
    """The words of `sentences_of`, without places."""
    out = []
    for sentence in SENTENCES.findall(text):
        found = WORDS.findall(sentence.lower())
        if len(found) <= SENTENCE_WORDS:
            if found:
                out.append(found if len(found) == 1 else list(dict.fromkeys(found)))
        else:
            out += [list(dict.fromkeys(found[at : at + SENTENCE_WORDS])) for at in range(0, len(found), SENTENCE_WORDS)]
    return out


def features_of(word: str) -> list[str]:
    """The word with its marks, and its n-grams."""
    marked = f"<{word}>"
    return [marked, *dict.fromkeys(marked[i : i + n] for n in GRAMS if n < len(marked) for i in range(len(marked) - n + 1))]


def sample(docs: DataFrame, labels: DataFrame, most_characters: int = MOST_CHARACTERS, most_labels: int = MOST_LABELS) -> pa.Table:
    """toxic, bags (words by sentence) of a bounded hashed sample of labelled documents, the same in every run."""
    marks = labels.select(quoted("doc_id").alias("_id"), quoted("toxic").cast("int").alias("_toxic")).filter("_id IS NOT NULL AND _toxic IN (0, 1)")
    n = {r["_toxic"]: r["n"] for r in marks.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    part = F.lit(False)
    for toxic, rows in n.items():
        part = part | ((F.col("_toxic") == toxic) & hashed_share(most_labels / 2 / rows, F.col("_id")))
    drawn = marks.filter(part).groupBy("_id").agg(F.max("_toxic").alias("toxic"))
    mine = docs.select(quoted("doc_id").alias("doc_id"), quoted("text").cast("string").alias("text")).filter("text IS NOT NULL")
    held = mine.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("toxic", "text", F.xxhash64(F.lit(13), "doc_id", "text").alias("h"))
    sizes = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()}  # two rows
    left, part = most_characters, F.lit(False)
    for k, (toxic, characters) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):  # what the smaller leaves goes to the larger
        mine_of = min(characters, left // (len(sizes) - k))
        left -= mine_of
        part = part | ((F.col("toxic") == toxic) & hashed_share(mine_of / max(characters, 1), F.col("h")))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = pa.array([bags_of(t) for t in batch.column("text").to_pylist()], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("h"), bags], ["toxic", "h", "bags"])

    return shipped(held.filter(part)).mapInArrow(cut_up, "toxic int, h long, bags array<array<string>>").toArrow().sort_by([("h", "ascending"), ("toxic", "ascending")])


class Bags:
    """The documents of a sample as arrays, and the features that tell toxic ones from clean ones.

    `words` are those of all sentences, one after the other; n_words are their lengths, n_sentences those of documents.
    Features are picked on the documents that are not `checks`.
    """

    def __init__(self, toxic: np.ndarray, n_sentences: np.ndarray, n_words: np.ndarray, words: pa.Array, checks: np.ndarray) -> None:
        coded = words.dictionary_encode()
        vocabulary, word = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        del coded
        sentence = np.repeat(np.arange(len(n_words)), n_words)
        self.toxic, self.n_sentences, self.n_words = toxic, len(n_words), len(vocabulary)
        self.document = np.repeat(np.arange(len(toxic)), n_sentences)
        seen_in = np.unique(word * len(toxic) + self.document[sentence])  # each word once a document
        label = np.where(checks, -1, toxic)[seen_in % len(toxic)]
        sizes, chunks = [], []
        for at in range(0, len(vocabulary), 20_000):  # as Python strings, all features at once would take some hundred MB
            lists = [features_of(w) for w in vocabulary[at : at + 20_000]]
            sizes += [len(x) for x in lists]
            chunks.append(pa.array([f for x in lists for f in x], pa.string()))
        owner = np.repeat(np.arange(len(vocabulary), dtype=np.int32), sizes)
        names = pa.concat_arrays(chunks or [pa.array([], pa.string())]).dictionary_encode()
        del chunks
        feature = names.indices.to_numpy()
        clean, bad = (np.bincount(feature, np.bincount(seen_in[label == k] // len(toxic), minlength=len(vocabulary))[owner], len(names.dictionary)) for k in (0, 1))
        n_clean, n_bad = (max((toxic[~checks] == k).sum(), 1) for k in (0, 1))
        telling = (clean + bad >= LEAST_DOCUMENTS) & (bad / n_bad > LIFT * clean / n_clean)
        kept = telling[feature]
        self.feature, self.owner = (np.cumsum(telling) - 1)[feature[kept]], owner[kept]
        self.names = names.dictionary.filter(pa.array(telling)).to_pylist()
        carries = np.bincount(self.owner, minlength=len(vocabulary)) > 0  # words without such features weigh nothing
        self.sentence, self.word = sentence[carries[word]], word[carries[word]]

    def logits(self, theta: np.ndarray) -> np.ndarray:
        """Of sentences; the bias is the last of theta."""
        value = np.bincount(self.owner, theta[self.feature], self.n_words)
        return theta[-1] + np.bincount(self.sentence, value[self.word], self.n_sentences)

    def quiet(self, z: np.ndarray) -> np.ndarray:
        """Of documents: minus the log of the chance that no sentence is toxic."""
        return np.bincount(self.document, np.logaddexp(0, z), len(self.toxic))

    def shares(self, used: np.ndarray) -> np.ndarray:
        """What each document weighs."""
        return used * np.where(self.toxic == 1, 1 / max((used & (self.toxic == 1)).sum(), 1), CLEAN_WEIGHT / max((used & (self.toxic == 0)).sum(), 1))

    def descend(self, used: np.ndarray, penalty: float) -> np.ndarray:
        share, k = self.shares(used), len(self.names)
        theta, mean, speed = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
        theta[-1] = -5.0
        for step in range(1, STEPS + 1):
            z = self.logits(theta)
            slope = np.where(self.toxic == 1, -1 / np.expm1(np.clip(self.quiet(z), 1e-9, 50)), 1.0) * share
            pull = slope[self.document] / (1 + np.exp(-z))
            by_word = np.bincount(self.word, pull[self.sentence], self.n_words)
            gradient = np.append(np.bincount(self.feature, by_word[self.owner], k), pull.sum())
            mean += 0.1 * (gradient - mean)
            speed += 0.01 * (gradient**2 - speed)
            rate = RATE / (np.sqrt(speed / (1 - 0.99**step)) + 1e-6)
            theta -= rate * mean / (1 - 0.9**step)
            theta[:-1] = np.maximum(theta[:-1] - rate[:-1] * penalty, 0)
        return theta

    def loss(self, theta: np.ndarray, used: np.ndarray) -> float:
        """Mean log loss, with chances kept off 0 and 1, as a few labels may be wrong."""
        chance = (1 - np.exp(-self.quiet(self.logits(theta)))).clip(0.01, 0.99)
        return float((self.shares(used) * -np.log(np.where(self.toxic == 1, chance, 1 - chance))).sum())


def fit(toxic: np.ndarray, n_sentences: np.ndarray, n_words: np.ndarray, words: pa.Array) -> tuple[float, dict[str, float]]:
    """Bias and weights by feature. Every fourth document tells which penalty serves others best; then all are learnt from."""
    checks = np.arange(len(toxic)) % 4 == 3
    bags = Bags(toxic, n_sentences, n_words, words, checks)
    penalty = min(PENALTIES, key=lambda p: bags.loss(bags.descend(~checks, p), checks))
    theta = bags.descend(np.ones(len(toxic), bool), penalty)
    return float(theta[-1]), {bags.names[i]: float(theta[i]) for i in np.flatnonzero(theta[:-1])}


class Model:
    """Chances of sentences and documents. Without a toxic document to learn from, all are 0."""

    def __init__(self, bias: float | None, weights: dict[str, float]) -> None:
        self.bias, self.weights, self.values = bias, weights, {}

    def value(self, word: str) -> float:
        found = self.values.get(word)
        if found is None:
            get = self.weights.get
            if len(self.values) >= REMEMBERED:
                self.values.clear()
            found = self.values[word] = sum(w for f in features_of(word) if (w := get(f)) is not None)
        return found

    def logits(self, bags: list[list[str]]) -> np.ndarray:
        value = self.value
        return np.array([sum(map(value, words)) for words in bags], np.float64) + self.bias

    def score(self, text: str | None) -> float:
        bags = bags_of(text or "") if self.bias is not None else []
        return float(-np.expm1(-np.logaddexp(0, self.logits(bags)).sum())) if bags else 0.0

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """start, end (code points) and chance of the sentences that are toxic rather than not."""
        found = list(sentences_of(text or "")) if self.bias is not None else []
        if not found:
            return []
        chance = 1 / (1 + np.exp(-self.logits([words for _, _, words in found])))
        return [(a, b, float(p)) for (a, b, _), p in zip(found, chance, strict=True) if p >= least]


def train(docs: DataFrame, labels: DataFrame, **bounds) -> Model:
    """Fit on doc_id, text and doc_id, toxic (0 or 1; the larger where they differ). The sample's size is bounded, so it may pass through the driver."""
    rows = sample(docs, labels, **bounds)
    toxic = rows.column("toxic").to_numpy().astype(np.int64)
    if not toxic.any():
        return Model(None, {})
    bags = rows.column("bags").combine_chunks()
    bags = bags.combine_chunks() if isinstance(bags, pa.ChunkedArray) else bags
    lengths = lambda a: pc.list_value_length(a).to_numpy(zero_copy_only=False).astype(np.int64)
    del rows
    sentences = bags.flatten()
    return Model(*fit(toxic, lengths(bags), lengths(sentences), sentences.flatten()))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, locate: bool = True) -> DataFrame:
    """All columns of docs, and toxicity (0 to 1), toxic (1 from threshold on), and with `locate` offending: start, end, chance of each sentence that is toxic rather than not, for documents that are.

    Columns of those names are replaced. Only the text is looked at.

    Defined cases: a null, empty or letterless text scores 0, as does every text where no toxic document was learnt from;
    whole texts count, however long; equal rows score alike; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample that the penalty left

    @F.pandas_udf("toxicity double, offending array<struct<start:int,end:int,chance:double>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        scores = [held.value.score(t) for t in texts]
        spans = [held.value.offending(t) if locate and s >= threshold else [] for t, s in zip(texts, scores, strict=True)]
        return pd.DataFrame({"toxicity": scores, "offending": spans})

    own = ("toxicity", "toxic", "offending") if locate else ("toxicity", "toxic")
    others = [c for c in docs.columns if c.lower() not in own]
    told = shipped(docs).select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(others)], judge.asNondeterministic()(quoted("text").cast("string")).alias("_told"))
    out = {"toxicity": F.col("_told.toxicity"), "toxic": (F.col("_told.toxicity") >= threshold).cast("int"), "offending": F.col("_told.offending")}
    return told.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], *[out[c].alias(c) for c in own])


def op13_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    share = training_share(F.col("doc_id"))
    model = train(docs.filter(share != 1), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mine = docs.select("doc_id", F.coalesce(share == 1, F.lit(False)).alias("held_out"), "text")
    return score(mine, model).select("doc_id", "held_out", F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"), F.size("offending").alias("n_offending"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_noisy_or_toxicity": op13_noisy_or_toxicity}
ORACLE: dict[str, str] = {}

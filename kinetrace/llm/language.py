"""Language identification by words first, backing off to ever shorter character n-grams for words not seen.

Training counts the words of a bounded sample of labelled documents, drawn by language, whole texts, in Spark; character
n-grams of all of them, with marks for word start and end, are counted from their counts. No word or n-gram of the sample is
left out, so its bound, a parameter, is the model's. A known word scores by its smoothed log frequency in each language, an
unknown one by the mean over those of its n-grams that are known, at the greatest length at which any is. A word is a run
of letters with the marks attached to them; numbers, also those written as letters or in circles, are none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.text import quoted
from kinetrace.plans.shared import cut, shipped

#: Letters with their marks, of any script.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST = 5
#: Characters of labelled text trained on at most, about, in all languages together. Each language gets an equal part, and uses what it has of it.
MOST_CHARACTERS = 16_000_000
#: Languages a model can tell apart; more are an error, none is left out.
MOST_LANGUAGES = 1_000
#: The score is a softmax over mean log frequency times the number of words, up to so many.
CERTAIN_WORDS = 25
#: Log frequencies of words that a task remembers, and those it looks up at once, in numbers (words times languages).
REMEMBERED = 2_000_000
AT_ONCE = 200_000


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def item_hash(item: str) -> int:
    return xxhash.xxh3_64_intdigest(item.encode("utf-8", "surrogatepass"))


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def training_share(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def sampled(docs: DataFrame, most_characters: int = MOST_CHARACTERS, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """lang, text of a hashed sample of the documents with text and lang; whole texts, by language a share that comes to an equal part of the bound."""
    labelled = docs.select(quoted("text").cast("string").alias("text"), quoted("lang").cast("string").alias("lang"), F.xxhash64(quoted("doc_id"), quoted("text")).alias("_h")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).limit(most_languages + 1).collect()  # a row a language
    if len(sizes) > most_languages:
        raise ValueError(f"over {most_languages} languages: most_languages must be raised, or rare ones joined")
    left, shares = most_characters, {}
    for k, row in enumerate(sorted(sizes, key=lambda r: (r["n"], r["lang"]))):  # what small languages leave of their parts goes to larger ones
        part = min(row["n"] or 0, left // (len(sizes) - k))
        left -= part
        shares[row["lang"]] = part / max(1, row["n"] or 0)
    if not shares:
        return labelled.select("lang", "text").filter(F.lit(False))
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    return labelled.filter(F.pmod("_h", F.lit(2**20)) < F.ceil(share * 2**20)).select("lang", "text")


def count_items(docs: DataFrame, **bounds) -> tuple[DataFrame, DataFrame]:
    """Word and n-gram counts by language (lang, item, n) from a sample of documents with text and lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, c in by_lang.items() for w, n in c.items()]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "item", "n"])

    words = shipped(sampled(docs, **bounds)).mapInArrow(count, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    words = cut(words)
    marked = F.concat(F.lit("<"), F.col("item"), F.lit(">"))
    places = words.select("lang", "n", marked.alias("w"), F.explode(F.sequence(F.lit(1), F.length(marked))).alias("i"))
    at = F.array_compact(F.array(*[F.when(F.col("i") + k <= F.length("w") + 1, F.substring("w", F.col("i"), F.lit(k))) for k in range(1, LONGEST + 1)]))
    return words, places.select("lang", "n", F.explode(at).alias("item")).groupBy("lang", "item").agg(F.sum("n").alias("n"))


class Items:
    """Counts by item and language as sorted arrays: 64-bit hashes of the items, and for each the languages that have it.

    Only counts over zero are held, so the size goes with the items a sample holds, not with items times languages: the log
    frequency of an item is its language's base (of a count of zero), and `more` where the language has the item.
    """

    def __init__(self, counts: pa.Table, langs: list[str], by_length: bool) -> None:
        counts = counts.combine_chunks()
        items = counts.column("item").combine_chunks().dictionary_encode()
        if not len(items):
            self.hashes, self.starts, self.lang, self.more = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
            self.bases = np.zeros((LONGEST + 1, len(langs)))
            return
        names = items.dictionary
        hashes = np.fromiter((item_hash(x.as_py()) for x in names), np.uint64, len(names))
        place = np.argsort(hashes)
        if (np.diff(hashes[place]) == 0).any():
            raise ValueError("two items of the sample share a hash")  # one in 10^6 for ten million items
        lang = pc.index_in(counts.column("lang"), pa.array(langs, pa.string())).to_numpy().astype(np.int32)
        n = counts.column("n").to_numpy().astype(np.float64)
        kinds = pc.utf8_length(names).to_numpy() if by_length else np.zeros(len(names), np.int32)
        kind, codes = kinds[items.indices.to_numpy()], items.indices.to_numpy()
        self.bases = np.zeros((LONGEST + 1, len(langs)))
        for k in np.unique(kinds).tolist():
            of = kind == k
            total = np.bincount(lang[of], n[of], len(langs)) + 0.5 * (kinds == k).sum()
            self.bases[k] = np.log(0.5 / total)
        rank = np.empty(len(place), np.int64)
        rank[place] = np.arange(len(place))
        order = np.lexsort((lang, rank[codes]))
        self.hashes = hashes[place]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(rank[codes], minlength=len(place)))])
        self.lang, self.more = lang[order], np.log(2 * n + 1)[order].astype(np.float32)  # log((n + 0.5) / total) less the base

    def find(self, items: list[str]) -> np.ndarray:
        """The place of each item, -1 for one that is not there."""
        if not items or not len(self.hashes):
            return np.full(len(items), -1)
        wanted = np.fromiter(map(item_hash, items), np.uint64, len(items))
        at = np.searchsorted(self.hashes, wanted).clip(max=len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)

    def added(self, at: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """By row and language, the sum over its items of weight times their `more`."""
        first, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        place = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        langs = self.bases.shape[1]
        return np.bincount(np.repeat(row, n) * langs + self.lang[place], self.more[place] * np.repeat(weight, n), rows * langs).reshape(rows, langs)


class Model:
    """Log frequencies by language of words and n-grams, held sparsely."""

    def __init__(self, words: pa.Table, grams: pa.Table) -> None:
        self.langs = sorted(pc.unique(words.column("lang")).to_pylist())
        self.words, self.grams = Items(words, self.langs, by_length=False), Items(grams, self.langs, by_length=True)
        self.seen: dict[str, int] = {}
        self.table: np.ndarray | None = None

    def frequencies(self, words: list[str]) -> np.ndarray:
        """Log frequencies by language of each word."""
        at = self.words.find(words)
        out, known, left = np.zeros((len(words), len(self.langs))), at >= 0, np.flatnonzero(at < 0)
        out[known] = self.words.bases[0] + self.words.added(at[known], np.arange(known.sum()), np.ones(known.sum()), known.sum())
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            grams = [grams_of(words[k], n) for k in left.tolist()]
            at, row = self.grams.find(list(chain.from_iterable(grams))), np.repeat(np.arange(len(left)), [len(g) for g in grams])
            row, at = row[at >= 0], at[at >= 0]
            hits = np.bincount(row, minlength=len(left))
            told = hits > 0
            out[left[told]] = self.grams.bases[n] + self.grams.added(at, row, 1 / hits[row], len(left))[told]
            left = left[~told]
        return out

    def remembered(self, words: list[str]) -> np.ndarray:
        """As `frequencies`; words that are remembered are not looked up again."""
        if self.table is None:
            self.table = np.empty((max(1, REMEMBERED // len(self.langs)), len(self.langs)))
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > len(self.table):
            self.seen.clear()
            new = words
        if new:
            self.table[len(self.seen) : len(self.seen) + len(new)] = self.frequencies(new)
            self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new)), strict=True))
        return self.table[np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))]

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text or ""))
        if not counts or not self.langs:
            return "und", 0.0
        names, times = list(counts), np.fromiter(counts.values(), np.float64, len(counts))
        step = min(max(1, AT_ONCE // len(self.langs)), max(1, REMEMBERED // len(self.langs)))
        other = sum(times[k : k + step] @ self.remembered(names[k : k + step]) for k in range(0, len(names), step))
        total = times.sum()
        logits = other / total * min(total, CERTAIN_WORDS)
        share = np.exp(logits - logits.max())
        best = int(share.argmax())  # the first language in a tie
        return self.langs[best], float(share[best] / share.sum())


def train(docs: DataFrame, **bounds) -> Model:
    """Fit on doc_id, text, lang; rows without text or lang are left out. The model holds items of the sample alone, whose size is bounded, so it may pass through the driver."""
    words, grams = count_items(docs, **bounds)
    return Model(*(df.select("lang", "item", "n").toArrow() for df in (words, grams)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, and lang_pred and score (0 to 1); columns of those names are replaced. Only the text is looked at.

    Defined cases: null, empty or letterless text, and a model without languages, give und and 0; ties go to the first
    language in order; whole texts count, however long.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "_told")]

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    # Only texts go to Python. Taken as not deterministic, so that a filter on the result doesn't run it twice.
    told = shipped(docs).select(*[quoted(c) for c in others], predict.asNondeterministic()(quoted("text").cast("string")).alias("_told"))
    return told.select(*[quoted(c) for c in others], "_told.lang_pred", "_told.score")


def language_filter(docs: DataFrame, least_score: float = 0.5, **bounds) -> DataFrame:
    """Documents whose language can be told, with their own columns; where lang is null it becomes the language told.

    The model is fitted on a sample of the documents that say their language. Defined cases: null, empty and letterless
    texts go; so do all if none says its language; rows with equal or null doc_id are judged each by its text; an empty table stays empty.
    """
    mine = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], quoted("text").alias("text"))
    told = identify(mine, train(docs, **bounds)).filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    said = lambda c, i: F.coalesce(F.col(f"c{i}"), "lang_pred") if c == "lang" else F.col(f"c{i}")
    return told.select(*[said(c, i).alias(c) for i, c in enumerate(docs.columns)])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    share = training_share(F.col("doc_id"))
    model = train(docs.filter(share != 2))
    held_out = docs.select("doc_id", "text", F.coalesce(share == 2, F.lit(False)).alias("held_out"))
    return identify(held_out.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_language_id": op10_language_id}
ORACLE: dict[str, str] = {}

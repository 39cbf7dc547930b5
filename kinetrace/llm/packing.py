"""Best-fit packing of tokenised documents by a configuration linear program over the length histogram.

Documents become pieces of at most `capacity` tokens. The histogram of piece lengths, at most `capacity` numbers, is all
that the plan needs: how many sequences to make of each configuration (which lengths share a sequence), so that all pieces
are covered by as few as can be. Multiplicative weights solve the fractional program (see Program): a length's price falls
as it is covered, and one knapsack dynamic program over the prices gives each round's configurations and a lower bound. The
amounts are then rounded to whole sequences, and knapsack tables fill in the pieces left. Spark then ranks the pieces of
each length, and a piece's rank says its sequence and place.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.text import quoted
from kinetrace.plans.shared import running_before, shipped, spread, stored

CAPACITY = 1024
END_ID = 2
#: Rounds of the program at most, and the gap of its bounds at which it ends. A round covers a length by STEP at most, less in later rounds.
ROUNDS, GAP, STEP = 400, 0.01, 0.5
#: Configurations worth this much less than the best are taken too: a round covers many lengths then.
NEARLY = 0.02
#: Shares of the fractional amounts that are rounded, the rest being filled in: with all of them, what is left lacks the short pieces that fill gaps. Each is tried with each of FILLS, and the fewest sequences are kept.
ROUNDED = (0.3, 0.9)
#: How the best dual prices change as the rest is filled in: the step by which they fall with coverage, and the power of the length by which they rise, so that what is hard to place goes first.
FILLS = ((0.1, 0.3), (0.3, 0.5))
#: A rounded program holds about so many at most, whatever the number of pieces.
MOST_CONFIGURATIONS = 50_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How this kind of vocabulary cuts texts into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as they are, the others from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TextIds:
    """Byte-level BPE ids as little-endian bytes.

    Ids are those of the tokenizers library for `path`. Texts that hold a special string go through it; all others through
    tiktoken, several times faster, if the file says that it cuts words by PATTERN and merges by rank, the ids being the
    ranks; a file that says anything else is left to the library.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        byte_of = byte_letters()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.model.get_vocab(with_added_tokens=True).items() if token not in self.special}
        self.merger = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if self.plain(path) else None

    @staticmethod
    def plain(path: str) -> bool:
        """Whether the file is a byte-level merge model as tiktoken knows it: nothing before the cutting, merges in the order of ids."""
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cutting, model = said.get("pre_tokenizer") or {}, said["model"]
        by_rank = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
        return (
            cutting.get("type") == "ByteLevel" and not cutting.get("add_prefix_space") and cutting.get("use_regex", True) and not said.get("normalizer")
            and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")) and None not in by_rank and by_rank == sorted(by_rank)
        )

    def ids(self, text: str) -> bytes:
        if self.merger is None or any(s in text for s in self.special):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.merger.encode_ordinary(text), "<u4").tobytes()


@lru_cache(maxsize=1)
def text_ids(path: str) -> TextIds:
    return TextIds(path)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, text to one row a piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for.

    Every text's ids, then end_id; more than `capacity` are cut from the end backwards, so only the first piece may be
    shorter. A null or empty text is one piece of end_id alone. Rows with equal or null doc_id are separate documents.
    """
    path = path or tokenizer_path()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, end = text_ids(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 500):
                rows: list[tuple] = []
                for doc_id, text in zip(doc_ids[at : at + 500], texts[at : at + 500], strict=True):
                    data = mine.ids(text) + end
                    n = len(data) // 4
                    first = n % capacity or capacity
                    starts = [0, *range(first, n, capacity)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        part = data[4 * a : 4 * b]
                        rows.append((doc_id, k, a, b - a, zlib.crc32(part), part) if with_ids else (doc_id, k, a, b - a, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    mine = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").alias("text"))
    return shipped(mine).mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unbounded knapsack: for each room its greatest worth, which length (its place) goes in next or -1 for none, and the room left then."""
    value, use, left = np.zeros(capacity + 1), np.full(capacity + 1, -1), np.zeros(capacity + 1, np.int64)
    fitting, back = np.searchsorted(lengths, np.arange(capacity + 1), side="right"), -lengths
    for room in range(int(lengths[0]), capacity + 1):
        each = worth[: fitting[room]] + value[room + back[: fitting[room]]]
        k = int(each.argmax())
        if each[k] > value[room - 1]:
            value[room], use[room], left[room] = each[k], k, room - lengths[k]
        else:  # one token stays empty
            value[room], use[room], left[room] = value[room - 1], use[room - 1], left[room - 1]
    return value, use, left


class Program:
    """The fractional covering program over configurations, by multiplicative weights; `primal` and `dual` bound its value.

    A length's price is its share of the room times exp(-how much of it is covered). Each round solves one knapsack table at
    the prices, which gives the best configuration through every length; those worth nearly the best of all are taken, each
    by so much that no length is covered by more than a step. The dual bound is the worth of all pieces over that of the best
    configuration, at a round's prices or at their average. The primal one is what the configurations taken come to, scaled
    to cover most of the lengths, with copies of one length alone for what is left open.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, gap: float = GAP) -> None:
        self.lengths = np.array(sorted(histogram), np.int64)
        self.n = np.array([histogram[x] for x in self.lengths.tolist()], float)
        self.capacity, self.size = capacity, len(self.lengths)
        self.cover, self.taken = np.zeros(self.size), 0.0
        self.primal, self.dual, self.scale, self.prices = math.inf, 0.0, 1.0, self.lengths / capacity
        self.found: list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = []
        average = np.zeros(self.size)
        for t in range(rounds):
            average += self.round(STEP / math.sqrt(1 + t / 25))
            if t % 25 == 24:
                self.bound(average, knapsack(self.lengths, average, capacity)[0])
                self.cost()
                if self.primal <= (1 + gap) * self.dual:
                    break
                if t + 1 in (100, 200, 400, 800):  # prices of the first rounds say little
                    average = np.zeros(self.size)

    def bound(self, prices: np.ndarray, value: np.ndarray) -> None:
        dual = float(self.n @ prices / value[self.capacity])
        if dual > self.dual:
            self.dual, self.prices = dual, prices / value[self.capacity]

    def round(self, step: float) -> np.ndarray:
        prices = self.lengths / self.capacity * np.exp(self.cover.min() - self.cover)
        value, use, left = knapsack(self.lengths, prices, self.capacity)
        self.bound(prices, value)
        first = np.flatnonzero(prices + value[self.capacity - self.lengths] >= (1 - NEARLY) * value[self.capacity])
        which, placed, room = np.arange(len(first)), first, self.capacity - self.lengths[first]
        places = [(which, placed)]
        while len(room):
            placed = use[room]
            fits = placed >= 0
            which, placed, room = which[fits], placed[fits], left[room[fits]]
            places.append((which, placed))
        each = self.n[first]
        load = sum(np.bincount(placed, each[which], self.size) for which, placed in places)
        most = np.full(len(first), np.inf)
        for which, placed in places:
            most[which] = np.minimum(most[which], self.n[placed] / load[placed])
        amounts = each * most * step
        self.cover += sum(np.bincount(placed, amounts[which], self.size) for which, placed in places) / self.n
        self.taken += amounts.sum()
        self.found.append((amounts, places))
        return prices / (self.n @ prices) * amounts.sum()

    def cost(self) -> None:
        """The least primal bound over some scales."""
        alone = self.n / (self.capacity // self.lengths)
        for scale in np.quantile(self.cover, np.linspace(0, 1, 51)):
            if scale > 0:
                primal = self.taken / scale + float(alone @ (1 - self.cover / scale).clip(0))
                if primal < self.primal:
                    self.primal, self.scale = primal, scale

    def rounded(self, share: float, most: int = MOST_CONFIGURATIONS) -> Counter:
        """Whole sequences of configurations, sorted (length, how often) pairs: that share of the fractional ones, but for what would hold more pieces than there are.

        The amounts are laid end to end and cut at equal distances, one sequence each or, if there are over `most`, several; a configuration gets what is cut off in it.
        """
        amounts = np.concatenate([a for a, _ in self.found]) * (share / self.scale)
        ends = np.cumsum(amounts)
        each = max(1, int(ends[-1]) // most)
        picked = np.diff(np.floor(ends / each + 0.5).astype(np.int64), prepend=0) * each
        left, out, at = dict(zip(self.lengths.tolist(), self.n.astype(int).tolist(), strict=True)), Counter(), 0
        for a, places in self.found:
            mine = picked[at : at + len(a)]
            at += len(a)
            configs: dict[int, Counter] = {k: Counter() for k in np.flatnonzero(mine).tolist()}
            for which, placed in places:
                wanted = mine[which] > 0
                for k, x in zip(which[wanted].tolist(), self.lengths[placed[wanted]].tolist(), strict=True):
                    configs[k][x] += 1
            for k, config in configs.items():
                amount = min(int(mine[k]), *(left[x] // times for x, times in config.items()))
                if amount:
                    out[tuple(sorted(config.items()))] += amount
                    for x, times in config.items():
                        left[x] -= times * amount
        return out


def filled(histogram: dict[int, int], capacity: int, prices: dict[int, float], step: float, power: float) -> Counter:
    """Configurations for the pieces that rounding leaves, in whole sequences: knapsack tables at `prices` times length ** power that fall with coverage by `step`. Those without room left are taken first, then ones with ever more."""
    left = {x: n for x, n in histogram.items() if n}
    out: Counter = Counter()
    allowed = 0
    while left:
        lengths = np.array(sorted(left))
        n = np.array([left[x] for x in lengths.tolist()], float)
        share = 1 - n / np.array([histogram[x] for x in lengths.tolist()])
        worth = np.array([prices[x] for x in lengths.tolist()]) * lengths**power * np.exp(-step * share) * (1 - 1 / (1 + n))  # the last few of a length are worth less: they can't fill many
        _, uses, _ = knapsack(lengths, worth, capacity)
        uses, names = uses.tolist(), lengths.tolist()
        taken = False
        for first in reversed(names):
            if first not in left:
                continue
            config, room = Counter({first: 1}), capacity - first
            while room > 0:
                x = names[uses[room]] if uses[room] >= 0 else 0
                if x and x <= room and config[x] < left.get(x, 0):
                    config[x] += 1
                    room -= x
                else:
                    room -= 1
            if capacity - sum(x * a for x, a in config.items()) > allowed:
                continue
            config = {x: a for x, a in config.items() if a}
            amount = min(left[x] // a for x, a in config.items())
            out[tuple(sorted(config.items()))] += amount
            taken = True
            for x, a in config.items():
                left[x] -= a * amount
                if not left[x]:
                    del left[x]
        if not taken:
            allowed = 2 * allowed + 1
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations and how many sequences each makes, that hold exactly the pieces of the histogram: the program, rounded, and the pieces then left filled in."""
    histogram = {length: n for length, n in histogram.items() if n}
    if not histogram:
        return []
    program = Program(histogram, capacity)
    prices = dict(zip(program.lengths.tolist(), program.prices.tolist(), strict=True))
    solved = []
    for share in ROUNDED:
        whole, left = program.rounded(share), Counter(histogram)
        for config, amount in whole.items():
            left.subtract({x: times * amount for x, times in config})
        solved += [whole + filled(left, capacity, prices, step, power) for step, power in FILLS]
    return [(dict(config), n) for config, n in min(solved, key=lambda c: sum(c.values())).items()]


def seats(configurations: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """By length and first rank: how many of that length a sequence holds, the first sequence, and the offset in it."""
    rows, taken, sequence = [], Counter(), 0
    for config, count in configurations:
        offset = 0
        for length, a in sorted(config.items(), reverse=True):
            rows.append(((length << 44) + taken[length], a, sequence, offset))
            taken[length] += a * count
            offset += a * length
        sequence += count
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pack(pieces: DataFrame, key: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored pieces (a table that reads alike each time) with a length of 1 to `capacity`.

    `key` orders pieces of one length. Ranks are taken in hashed buckets, so one very common length is no hot key. Only the
    histogram, at most `capacity` rows, reaches the driver, and the plan, a few rows a configuration, goes back.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    first, each, sequence, offset = seats(plan(histogram, capacity))
    hashed = shipped(pieces).withColumn("_hash", F.xxhash64(*key)).withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(spread(sum(histogram.values())))))
    ranked = running_before(hashed, ["length"], "_bucket", ["_hash", *key], F.lit(1), "_rank")

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy() << 44) + rank.to_numpy()
        at = np.searchsorted(first, key, side="right") - 1
        nth, among = (key - first[at]) // each[at], (key - first[at]) % each[at]
        return pd.DataFrame({"sequence_id": sequence[at] + nth, "offset": offset[at] + among * length.to_numpy()})

    return ranked.withColumn("_seat", seat("length", "_rank")).select(*pieces.columns, "_seat.sequence_id", "_seat.offset")


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Tokenise once, keep the pieces (spans, no ids) in the shared folder, and pack them: a row a piece.

    Defined cases: a null or empty text is one piece of end_id alone; rows with equal or null doc_id are separate documents,
    and pieces that are equal in all columns may swap places; other columns are not looked at; an empty table stays empty.
    """
    pieces = stored(token_pieces(docs, **options), "pieces")
    return pack(pieces, ["doc_id", "piece", "start", "ids_crc32"])


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLE: dict[str, str] = {}

"""Table functions for SQL: windows of a length, and prompts of an episode by a sweep over its intervals."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

from kinetrace.plans.shared import shipped


class Windows:
    """kt_windows(length, history, future, stride, tail, fps): a row a window, as `make_windows` gives. Null or short lengths give none."""

    @staticmethod
    def analyze(length: AnalyzeArgument, history: AnalyzeArgument, future: AnalyzeArgument, stride: AnalyzeArgument | None = None, tail: AnalyzeArgument | None = None, fps: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, given in (("history", history), ("future", future), ("stride", stride)):
            if given is not None and given.isConstantExpression and (given.value is None and name != "stride" or given.value is not None and given.value < 1):
                raise ValueError(f"{name} must be at least 1")
        ints, times = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
        out = T.StructType().add("start", T.IntegerType()).add("anchor_index", T.IntegerType()).add("history_indices", ints).add("future_indices", ints)
        return AnalyzeResult(out.add("history_time_seconds", times).add("future_time_seconds", times))

    def eval(self, length: int, history: int, future: int, stride: int | None = None, tail: bool = True, fps: float = 30.0) -> Iterator[tuple]:
        last = -1 if length is None else length - history - future
        starts = list(range(0, last + 1, stride or future))
        if tail and starts and starts[-1] != last:
            starts.append(last)
        before, after = [k / float(fps) for k in range(1 - history, 1)], [k / float(fps) for k in range(1, future + 1)]
        for s in starts:
            yield s, s + history - 1, list(range(s, s + history)), list(range(s + history, s + history + future)), before, after


class PromptSweep:
    """kt_prompts(TABLE of episode, hand, place, start, end, text as boundaries): the prompts an episode's segments show, each once.

    Takes the rows of `boundaries`, an episode at a time in the order of their places. Open intervals are kept in a heap for
    each hand, the least place (then text, a null one first) on top; what has ended is taken off when it comes up. So an episode of n intervals
    takes n log n steps, and only its open intervals are held.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"episode", "at", "hand", "place", "end", "text"} <= {f.name for f in rows.dataType.fields}:
            raise ValueError("kt_prompts takes a table of boundaries")
        episode = next(f for f in rows.dataType.fields if f.name == "episode")
        return AnalyzeResult(T.StructType().add("episode", episode.dataType).add("prompt", "string"), partitionBy=[PartitioningColumn("episode")], orderBy=[OrderingColumn("at")])

    def __init__(self) -> None:
        self.open: dict[str | None, list[tuple]] = {}
        self.episode, self.at, self.said, self.waiting = None, None, set(), set()

    def prompt(self) -> str:
        clauses = []
        for hand, heap in self.open.items():
            while heap and heap[0][3] <= self.at:
                heapq.heappop(heap)
            if heap and hand is not None and heap[0][1]:
                clauses.append(f"{hand[:1].upper()}{hand[1:].lower()} hand: {heap[0][2]}")
        return " ".join(sorted(clauses))

    def eval(self, row) -> Iterator[tuple]:
        self.episode = row["episode"]
        if self.at is not None and row["at"] != self.at:
            self.waiting.add(self.prompt())  # of the segment that began at the last boundary, if any interval ends after it
        if row["place"] is None and self.at is not None:  # an end: all segments so far began before it
            yield from self.told()
        self.at = row["at"]
        if row["place"] is not None and row["at"] < row["end"]:
            heapq.heappush(self.open.setdefault(row["hand"], []), (row["place"], row["text"] is not None, row["text"] or "", row["end"]))

    def told(self) -> Iterator[tuple]:
        for prompt in self.waiting - self.said:
            self.said.add(prompt)
            yield self.episode, prompt
        self.waiting.clear()

    def terminate(self) -> Iterator[tuple]:
        return iter(())


def boundaries(intervals: DataFrame) -> DataFrame:
    """episode, at, hand, place, end, text: a row for each interval's start, and rows without a place for its end and for 0."""
    none = lambda c: F.lit(None).cast(intervals.schema[c].dataType).alias(c)
    start = F.struct(F.col("start").cast("long").alias("at"), "hand", F.coalesce("place", F.lit(2**62)).cast("long").alias("place"), F.col("end").cast("long").alias("end"), "text")
    mark = lambda at: F.struct(at.cast("long").alias("at"), none("hand"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("end"), none("text"))
    rows = intervals.select("episode", F.explode(F.array(start, mark(F.col("end")))).alias("_b")).select("episode", "_b.*")
    zero = intervals.select("episode").distinct().select("episode", F.inline(F.array(F.struct(F.lit(0).cast("long").alias("at"), none("hand"), F.lit(2**62).cast("long").alias("place"), F.lit(0).cast("long").alias("end"), none("text")))))
    return rows.unionByName(zero)


def register(spark: SparkSession) -> None:
    """Make kt_windows and kt_prompts known to the session's SQL."""
    shipped(spark.range(1))
    spark.udtf.register("kt_windows", udtf(Windows))
    spark.udtf.register("kt_prompts", udtf(PromptSweep))


def prompts_by_sweep(intervals: DataFrame) -> DataFrame:
    """episode, prompt: what each episode's segments show, each prompt once an episode."""
    register(intervals.sparkSession)
    return intervals.sparkSession.sql("SELECT * FROM kt_prompts(TABLE({rows}))", rows=boundaries(intervals))

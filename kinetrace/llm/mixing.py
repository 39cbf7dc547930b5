"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Van der Corput points say which source each slot of the mix reads: the 2**m bit-reversed cell numbers are the points,
and cumulative slot counts by source are the weights they are mapped through, so that every source gets its exact
number of slots, evenly spread over the mix. Ranking a source's slots says which block of equal token count each of
them reads; blocks are cut from the source's shuffled documents, which repeat once where the target is above the
source's size. Everything is DataFrame functions: a few small tables by source, and one join of (source, block).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrace.llm.text import hex_order, n_words, quoted, text_of
from kinetrace.plans.shared import cut, in_ranges, running_before, same, stored

SEED = 20
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_EPOCHS = 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, size) rows to one row a source: source_size, target.

    Sources in code point order, null last, have the weights in turn. A target is at most `most_epochs` times the
    source's size, and what is above is shared again by weight. With sources ordered by cap over weight, each level
    'what is left / weight left' rises while sources are capped and falls after, so the water level is their maximum.
    The window is over one row a source: the number of sources bounds it, not the number of documents.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * most_epochs
    by_level = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    each = each.select(
        "source", "source_size", "weight",
        F.coalesce(F.sum(cap).over(by_level), F.lit(0)).alias("_capped"),
        F.coalesce(F.sum("weight").over(by_level), F.lit(0)).alias("_weight_before"),
        F.sum("source_size").over(whole).alias("_all"), F.sum("weight").over(whole).alias("_weights"),
    )
    level = (F.col("_all") * share_percent - F.col("_capped") * 100) / F.lit(100.0) / (F.col("_weights") - F.col("_weight_before"))
    each = each.withColumn("_level", F.max(level).over(whole))
    return each.select("source", "source_size", F.least((F.col("source_size") * most_epochs).cast("double"), F.col("weight") * F.col("_level")).alias("target"))


def slots(targets: DataFrame, block_words: Column | int, cells_a_row: int = 4096) -> DataFrame:
    """(source, take) to the schedule: source, slot, rank; `take` words of a source make ceil(take / block) slots.

    Cell c of 2**m is slot reverse(c) in m bits. A source's cells are a range of a length known beforehand; it is dealt out in
    runs of `cells_a_row`, so that no task makes a whole source. Slots are unique and in mix order, not gapless.
    """
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cells = targets.withColumn("_n", F.ceil(F.col("take") / block_words).cast("long")).filter("_n > 0")
    cells = cells.withColumn("_all", F.sum("_n").over(whole)).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    cells = cells.withColumn("_bits", F.greatest(F.length(F.bin(F.col("_all") - 1)), F.lit(1)))
    runs = cells.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(cells_a_row))))
    runs = runs.repartition("source", "_from")
    cell = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + cells_a_row, F.col("_n")) - 1))
    dealt = runs.withColumn("_cell", cell)
    slot = F.conv(F.reverse(F.lpad(F.bin(F.col("_first") + F.col("_cell")), F.col("_bits"), F.lit("0"))), 2, 10).cast("long")
    dealt = dealt.select("source", slot.alias("slot"), F.floor(F.sqrt(F.pow(F.lit(2.0), F.col("_bits")))).cast("long").alias("_run"))
    dealt = dealt.withColumn("_bucket", F.expr("slot div _run"))
    return running_before(dealt, ["source"], "_bucket", ["slot"], F.lit(1), "rank").select("source", "slot", "rank")


def mix_segments(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_epochs: int = MOST_EPOCHS, slots_wanted: int = 2**17, block_range: tuple[int, int] = (16, 4096), row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix as spans of documents, and the documents it drew on.

    Takes doc_id, text, source. Returns (segments, rows): rows has _row, doc_id, source, size, source_size, target for
    every document; segments has _row, slot, epoch, from_word, to_word: slot by slot what the mix reads. `_row` is the
    column of docs named by `row`, which must be unique; without it rows are numbered here, once, and only the two results share the numbers.

    Defined cases: a null or empty text has no words and is in no segment; null is a source like any other; rows with
    equal doc_id are separate documents; an empty table gives empty results; other columns are not looked at.
    """
    spark = docs.sparkSession
    number = F.monotonically_increasing_id() if row is None else quoted(row)
    base = docs.select(quoted("doc_id").alias("doc_id"), quoted("source").alias("source"), n_words(text_of()).alias("size"), number.alias("_row"))
    base = in_ranges(base.withColumn("_order", hex_order(seed, F.col("doc_id"))), ["_order", "_row"])  # rows that share a doc_id, or have none, are spread by their number
    targets = cut(source_targets(base.select("source", "size"), weights, share_percent, most_epochs))
    wanted = targets.agg(F.sum("target")).first()[0] or 0
    block = int(min(max(-(-wanted // slots_wanted), block_range[0]), block_range[1]))
    targets = targets.withColumn("take", F.least(F.round("target").cast("long"), F.col("source_size") * most_epochs))
    placed = running_before(base, ["source"], "_part", ["_order", "_row"], F.col("size"), "start")
    placed = same(placed, targets, ["source"])
    rows = placed.select("_row", "doc_id", "source", "size", "source_size", "target")
    passes = placed.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most_epochs - 1))))
    passes = passes.withColumn("_from", F.col("epoch") * F.col("source_size") + F.col("start")).withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("take"))).filter("_from < _to")
    read = passes.withColumn("rank", F.explode(F.sequence(F.expr(f"_from div {block}"), F.expr(f"(_to - 1) div {block}"))))
    read = read.select("_row", "source", "epoch", "rank", (F.greatest(F.col("_from"), F.col("rank") * block) - F.col("_from")).alias("from_word"), (F.least(F.col("_to"), (F.col("rank") + 1) * block) - F.col("_from")).alias("to_word"))
    schedule = slots(targets, F.lit(block))
    segments = same(read, schedule, ["source", "rank"]).select("_row", "slot", "epoch", "from_word", "to_word")
    return segments, rows


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix in whole documents, in the order of its schedule, with the columns of docs, whatever their names: a document is read once for each pass of which the mix takes at least half its words.

    A pass stands where the schedule first reads of it. Rows are numbered once, in a stored table that the mix and the result are both read from:
    another scan of docs may number them otherwise. Defined cases: a null or empty text has no words and is not in the mix; null
    is a source like any other; rows with equal or null doc_id are separate documents; an empty table stays empty.
    """
    held = stored(docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.monotonically_increasing_id().alias("_row")), "mix")
    at = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    segments, rows = mix_segments(held.select(*[F.col(at[c]).alias(c) for c in ("doc_id", "text", "source")], "_row"), row="_row", **options)
    passes = segments.groupBy("_row", "epoch").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("_taken"), F.min("slot").alias("_slot"))
    passes = passes.join(rows.select("_row", "size"), "_row").filter(2 * F.col("_taken") >= F.col("size"))
    taken = held.join(passes.select("_row", "epoch", "_slot"), "_row").orderBy("_slot", "epoch", "_row")
    return taken.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, rows = mix_segments(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = segments.groupBy("_row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    out = rows.join(taken, "_row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_source_mix": op1_source_mix}

ORACLE = {
    "op1_source_mix": r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('20|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o
  FROM documents),
each AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM each),
levels AS (
  SELECT *, coalesce(sum(source_size * 2) OVER w, 0)::BIGINT AS capped, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_before,
         (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights
  FROM weighed
  WINDOW w AS (ORDER BY source_size * 2 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         least((source_size * 2)::DOUBLE, weight * max((total * 150 - capped * 100)::DOUBLE / 100.0::DOUBLE / (weights - weight_before)) OVER ()) AS target
  FROM levels),
placed AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, least(round(t.target)::BIGINT, t.source_size * 2) AS take,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(least(start + size, take) - start, 0) + greatest(least(source_size + start + size, take) - source_size - start, 0))::BIGINT AS taken
FROM placed""",
}

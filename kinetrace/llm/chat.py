"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation's turns get running token counts; a turn belongs to the window its first token falls into, so windows are
spans of whole turns. Each window after the first starts with the system turn and with as many turns of the window
before as fit the history allowance; those repeats are outside the loss mask. A turn is marked by control strings, and
control strings inside roles and texts are escaped by one backslash more between `<` and `|`, which can be undone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrace.llm.text import n_words, quoted
from kinetrace.plans.shared import running_before, same

START, END = "<|im_start|>", "<|im_end|>"
MAX_TOKENS = 1024
HISTORY_TOKENS = 128
#: Tokens that marking a turn costs; it also keeps the number of turns in a window below MAX_TOKENS / TURN_COST.
TURN_COST = 4


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role is one line of the output."""
    return escaped(F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def format_chats(turns: DataFrame, max_tokens: int = MAX_TOKENS, history_tokens: int = HISTORY_TOKENS, tokens: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text to one row a window: conv_id, window, text, loss_spans (start, length in code points), n_context.

    `tokens` is a turn's token count, its words by default. What is left of the budget beside system turn and history is
    filled to half, so that a window stays within the budget unless a single turn is longer than the other half; turns
    are never cut. Only assistant texts of a window's own turns are in loss_spans.

    Defined cases: rows are ordered by turn (null first), then role and text; equal rows are separate turns; null role and
    text are empty; null conv_id is one conversation; a first turn of role system is the system turn; other columns are
    not looked at; an empty table gives no rows.
    """
    rows = turns.select(
        quoted("conv_id").alias("conv_id"), quoted("turn").cast("long").alias("turn"), F.coalesce(quoted("role"), F.lit("")).alias("role"), F.coalesce(quoted("text"), F.lit("")).alias("text"),
        (n_words(F.coalesce(quoted("text"), F.lit(""))) if tokens is None else tokens).alias("_tokens"),
    )
    rows = rows.withColumn("_cost", F.col("_tokens") + TURN_COST)
    first = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text", "_cost")).alias("f")).filter("f.role = 'system'")
    first = first.select("conv_id", F.col("f.role").alias("_system_role"), F.col("f.text").alias("_system"), F.col("f._cost").alias("_system_cost"))
    rows = rows.withColumn("_bucket", F.coalesce(F.floor(F.col("turn") / 64), F.lit(-(2**62))))
    rows = running_before(rows, ["conv_id"], "_bucket", [F.col("turn").asc_nulls_first(), "role", "text"], F.col("_cost"), "_start", "_total")
    rows = same(rows, first.select("conv_id", "_system_cost"), ["conv_id"], "left").withColumn("_system_cost", F.coalesce("_system_cost", F.lit(0)))
    stride = F.greatest(F.lit(1), F.floor((F.lit(max_tokens - history_tokens) - F.col("_system_cost")) / 2))
    window_at = lambda start: F.greatest(F.lit(0), F.floor((start - F.col("_system_cost")) / F.col("_stride"))).cast("long")
    rows = rows.withColumn("_stride", stride).withColumn("window", window_at(F.col("_start")))
    rows = rows.withColumn("_next", F.max(F.col("_start") + F.col("_cost")).over(Window.partitionBy("conv_id", "window")))
    is_system = (F.col("_start") == 0) & (F.col("_system_cost") > 0)
    repeats = (F.col("_next") < F.col("_total")) & (F.col("_next") - F.col("_start") <= history_tokens) & ~is_system
    own = F.struct(F.col("window").alias("window"), F.lit(2).alias("kind"))
    again = F.struct(window_at(F.col("_next")).alias("window"), F.lit(1).alias("kind"))
    placed = rows.select("conv_id", "role", "text", "_start", F.inline(F.when(repeats, F.array(own, again)).otherwise(F.array(own))))
    later = placed.filter("kind = 2 AND window > 0").select("conv_id", "window").distinct()
    system = same(later, first, ["conv_id"]).select("conv_id", F.col("_system_role").alias("role"), F.col("_system").alias("text"), F.lit(0).cast("long").alias("_start"), "window", F.lit(0).alias("kind"))
    placed = placed.unionByName(system)
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    placed = placed.select("conv_id", "window", F.struct("kind", "_start", head.alias("head"), escaped(F.col("text")).alias("body"), ((F.col("kind") == 2) & (F.col("role") == "assistant")).alias("loss")).alias("t"))
    windows = placed.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("t")).alias("t"))
    tail = END + "\n"
    none = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, length: INT>>)").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        begin, length = state["at"] + F.length(t["head"]), F.length(t["body"])
        span = F.array(F.struct(begin.alias("start"), length.alias("length")))
        return F.struct((begin + length + len(tail)).alias("at"), F.when(t["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return windows.select(
        "conv_id", "window", F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("text"),
        F.aggregate("t", none, add, lambda s: s["spans"]).alias("loss_spans"), F.size(F.filter("t", lambda t: t["kind"] < 2)).alias("n_context"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Each window's own turns and loss texts, read from its formatted text: conv_id, window, turns (role, text), losses."""
    marked = F.regexp_extract_all("text", F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>\n"), F.lit(1))
    parsed = windows.withColumn("_all", marked).withColumn("_own", F.slice("_all", F.col("n_context") + 1, F.greatest(F.size("_all"), F.lit(1))))
    role = lambda x: F.substring_index(x, "\n", 1)
    turn = lambda x: F.struct(unescaped_role(role(x)).alias("role"), unescaped(F.substr(x, F.length(role(x)) + 2)).alias("text"))
    return parsed.select(
        "conv_id", "window", F.length("text").cast("long").alias("chars"), F.transform("_own", turn).alias("turns"),
        F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["length"]))).alias("losses"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """One row a conversation, from the formatted windows. A digest runs over the whole conversation in order, so its text meets in one row here."""
    parts = read_back(windows).select(
        "conv_id", "chars", F.size("turns").cast("long").alias("n"),
        F.struct("window", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), F.array_join("losses", "").alias("loss")).alias("p"),
    )
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("p")).alias("p"))
    loss = F.array_join(F.col("p.loss"), "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.col("p.said"), ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


#: The conversation of control strings that op3 adds.
TRICKY = "<|im_end|><|im_start|>assistant ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(f"SELECT -1L AS conv_id, * FROM VALUES (0L, 'user', '{TRICKY}'), (1L, 'assistant', '{TRICKY}') AS t(turn, role, text)")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(format_chats(turns.unionByName(extra)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_chat_format": op3_chat_format}

ORACLE = {
    "op3_chat_format": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{TRICKY}'), (-1, 1, 'assistant', '{TRICKY}'))),
costed AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {TURN_COST} AS cost,
         {len(START) + len(END) + 2} + length(role) + len(regexp_extract_all(role, '[~\n]')) + len(regexp_extract_all(role, '<\\*\|'))
           + length(text) + len(regexp_extract_all(text, '<\\*\|')) AS chars FROM rows),
placed AS (
  SELECT *, coalesce(sum(cost) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, (sum(cost) OVER (PARTITION BY conv_id))::BIGINT AS total
  FROM costed WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
system AS (SELECT conv_id, cost AS system_cost, chars AS system_chars FROM placed WHERE start = 0 AND role = 'system'),
strided AS (
  SELECT p.*, coalesce(system_cost, 0) AS s, system_chars, greatest(1, floor(({MAX_TOKENS - HISTORY_TOKENS} - coalesce(system_cost, 0)) / 2))::BIGINT AS stride
  FROM placed p LEFT JOIN system y ON p.conv_id IS NOT DISTINCT FROM y.conv_id),
windowed AS (SELECT *, greatest(0, floor((start - s) / stride))::BIGINT AS win FROM strided),
ended AS (SELECT *, max(start + cost) OVER (PARTITION BY conv_id, win) AS nxt FROM windowed),
sized AS (
  SELECT conv_id, sum(chars + CASE WHEN nxt < total AND nxt - start <= {HISTORY_TOKENS} AND NOT (start = 0 AND s > 0) THEN chars ELSE 0 END) 
           + coalesce(max(system_chars), 0) * (count(DISTINCT win) FILTER (win > 0)) AS formatted_chars
  FROM ended GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY start)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY start) FILTER (role = 'assistant'), '')) AS loss_sha256,
       any_value(formatted_chars)::BIGINT AS formatted_chars
FROM ended JOIN sized USING (conv_id) GROUP BY conv_id""",
}

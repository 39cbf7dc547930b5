"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document whose statistic is at or above a cutoff. For each stratum (language), rule and candidate
cutoff, labelled good documents say how often the rule rejects wrongly: k of n. A cutoff may be used only if the exact
binomial tail P(Bin(n, risk) <= k) is at most confidence / number of tests, that is, if a false rejection rate above
`risk` is excluded with a Bonferroni correction over all strata, rules and cutoffs. Among those the one is taken that
catches most labelled bad documents, each good one counting against it `cost` times; where none catches any, the
stratum goes without the rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrace.llm.text import SPACES, WORD, quoted, text_of, without
from kinetrace.plans.shared import stored

WINDOW = 8
RISK = 0.05
CONFIDENCE = 0.05
COST = 10
#: Candidate cutoffs by rule: shares of symbols to word characters, of repeated lines, of words in repeated windows; word length.
CUTOFFS = {
    "symbols": (0.02, 0.05, 0.1, 0.2, 0.3),
    "dup_lines": (0.1, 0.2, 0.3, 0.5, 0.7),
    "repeats": (0.05, 0.1, 0.15, 0.2, 0.25),
    "word_length": (7.0, 8.0, 9.0, 10.0, 12.0),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_base(df: DataFrame, text: Column | None = None) -> DataFrame:
    """Add the base counts of each text, and base_failed. Null texts count as empty. All work on a text stays in its row.

    Words in repeated windows: windows are hashed, and (hash, place) pairs sorted, so that the work is n log n in the
    number of words however often they repeat; it is done only for texts in which two windows agree.
    """
    n = F.col("n_words")
    kept = [quoted(c) for c in without(df, *BASE, "_n_lines", "base_failed")]
    df = df.withColumn("_t", text if text is not None else text_of())
    df = df.withColumn("_hashes", F.transform(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda line: line.rlike(WORD)))
    df = df.withColumn("n_words", F.size("_hashes").cast("long"))
    one_window = lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])
    df = df.withColumn("_windows", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n.cast("int") - WINDOW), one_window)))
    sorted_windows = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), sorted_windows))
    equal = lambda x, k: F.coalesce(F.get("_sorted", k)["h"] == x["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, k: (F.when(k > 0, equal(x, k - 1)).otherwise(F.lit(False))) | equal(x, k + 1))
    df = df.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", k + 1) - p, F.lit(WINDOW))))
    df = df.withColumn("word_chars", F.length(F.translate("_t", SPACES, "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = df.withColumn("_n_lines", F.size("_lines").cast("long"))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    df = df.withColumn("base_failed", (n < 20) | (100 * F.col("n_repeat_words") > 30 * n))
    # A generator between these columns and what follows: a later filter on them would else be pushed down with every column it names written out inside its lambdas.
    return df.select(*kept, F.inline(F.array(F.struct(*BASE, "_n_lines", "base_failed"))))


def statistics() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "_n_lines"), "repeats": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words")}


def most_rejections(n: Column, risk: float, level: Column) -> Column:
    """The largest k with P(Bin(n, risk) <= k) <= level, or -1. Terms are carried as logarithms, so large n don't underflow."""
    odds = F.lit(risk / (1 - risk))
    start = F.struct((n * F.log(F.lit(1 - risk))).alias("log_term"), F.lit(0.0).alias("below"), F.lit(-1).cast("long").alias("best"))

    def step(state: Column, k: Column) -> Column:
        below = state["below"] + F.exp(state["log_term"])
        ahead = state["log_term"] + F.log(F.greatest(n - k, F.lit(1e-300)) / (k + 1) * odds)
        return F.struct(ahead.alias("log_term"), below.alias("below"), F.when(below <= level, k.cast("long")).otherwise(state["best"]).alias("best"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * risk).cast("long")), start, step, lambda s: s["best"])


def marks_of(labels: DataFrame, most_labels: int | None = None) -> DataFrame:
    """doc_id, _good of all labelled documents; only a caller that names `most_labels` gets a hashed share of about so many."""
    marks = labels.select(quoted("doc_id").alias("_id"), quoted("quality").alias("_q")).filter("_id IS NOT NULL AND _q IS NOT NULL")
    kept_share = min(1.0, most_labels / max(1, marks.count())) if most_labels is not None else 1.0
    marks = marks.filter(F.xxhash64("_id") < int(-(2**63) + kept_share * 2**64)) if kept_share < 1 else marks
    return marks.groupBy("_id").agg(F.min("_q").alias("_good"))


def cutoffs(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row a stratum and rule that may be used: stratum, rule, cutoff. Takes doc_id, text, lang and doc_id, quality (1 good, 0 bad)."""
    return cutoffs_of(with_base(docs.select(quoted("doc_id").alias("doc_id"), quoted("text").alias("text"), quoted("lang").alias("lang"))), labels, **options)


def cutoffs_of(based: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE, cost: int = COST, most_labels: int | None = None) -> DataFrame:
    """`cutoffs` of documents with base counts. All labels count. Texts don't move: what meets the labels are counts."""
    held = based.filter("NOT base_failed").select("doc_id", F.col("lang").alias("stratum"), *BASE, "_n_lines")
    held = held.join(marks_of(labels, most_labels), F.col("doc_id") == F.col("_id"))
    tests = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), (statistics()[rule] >= c).alias("hit")) for rule, cs in CUTOFFS.items() for c in cs])
    counts = held.select("stratum", "_good", F.explode(tests).alias("t")).groupBy("stratum", "t.rule", "t.cutoff").agg(
        F.count_if(F.col("_good") == 1).alias("n"),
        F.count_if((F.col("_good") == 1) & F.col("t.hit")).alias("k"),
        F.count_if((F.col("_good") == 0) & F.col("t.hit")).alias("caught"),
    )
    counts = counts.withColumn("_tests", F.count(F.lit(1)).over(Window.partitionBy()))
    counts = counts.withColumn("_most", most_rejections(F.col("n"), risk, F.lit(confidence) / F.col("_tests")))
    gain = F.col("caught") - F.lit(cost) * F.col("k")
    usable = counts.filter((F.col("k") <= F.col("_most")) & (gain > 0))
    best = usable.withColumn("_place", F.row_number().over(Window.partitionBy("stratum", "rule").orderBy(gain.desc(), "cutoff")))
    return best.filter("_place = 1").select("stratum", "rule", "cutoff")


def apply_rules(based: DataFrame, chosen: DataFrame) -> DataFrame:
    """Add failed_rules and kept to documents with base counts and lang.

    `chosen` is broadcast: it has a few rows for a stratum, and only if that has dozens of labels, enough for an admissible
    cutoff; so it grows with the languages. Documents are not moved, however many share a language.
    """
    by_stratum = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    by_stratum = stored(by_stratum, "cutoffs")
    judged = based.join(F.broadcast(by_stratum.withColumnRenamed("stratum", "_stratum")), quoted("lang").eqNullSafe(F.col("_stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(stat >= F.element_at("_cutoffs", rule), F.lit(rule)) for rule, stat in statistics().items()]))
    judged = judged.withColumn("failed_rules", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return judged.drop("_stratum", "_cutoffs", "_n_lines")


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Documents that pass, with their own columns, whatever their names. Documents are not shuffled.

    Defined cases: a null or empty text fails the base rule; a null language is a stratum of its own; rows with equal or
    null doc_id are judged each by its text; without labels only the base rule holds; labels without a document are left out; an empty table stays empty.
    """
    mine = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_doc"), quoted("text").alias("text"), quoted("lang").alias("lang"))
    return apply_rules(with_base(mine), cutoffs(docs, labels, **options)).filter("kept").select("_doc.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    based = stored(with_base(docs).drop("text"), "based")  # counts alone, which both the cutoffs and the verdicts take
    chosen = cutoffs_of(based, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(based, chosen).select("doc_id", *BASE, "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_quality_rules": op9_quality_rules}

_TESTS = ", ".join(f"('{rule}', {float(c)}::DOUBLE)" for rule, cs in CUTOFFS.items() for c in cs)

ORACLE = {
    "op9_quality_rules": rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - 7)) AS i FROM split WHERE len(words) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
base AS (
  SELECT s.r, doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered c ON s.r = c.r),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_symbols::DOUBLE / greatest(word_chars, 1) AS symbols, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_lines,
         n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeats, word_chars::DOUBLE / greatest(n_words, 1) AS word_length FROM base),
marks AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
tests(rule, cutoff) AS (VALUES {_TESTS}),
counts AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND stat >= cutoff) AS k,
         count(*) FILTER (good = 0 AND stat >= cutoff) AS caught
  FROM (SELECT stratum, good, rule, cutoff,
               CASE rule WHEN 'symbols' THEN symbols WHEN 'dup_lines' THEN dup_lines WHEN 'repeats' THEN repeats ELSE word_length END AS stat
        FROM judged JOIN marks USING (doc_id) CROSS JOIN tests WHERE NOT base_failed)
  GROUP BY ALL),
tails AS (
  SELECT n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({RISK}) + (n - k) * ln(1 - {RISK}))) OVER (PARTITION BY n ORDER BY k) AS below
  FROM (SELECT n, unnest(range(0, ceil(n * {RISK})::BIGINT + 1)) AS k FROM (SELECT DISTINCT n FROM counts))),
most AS (SELECT n, coalesce(max(k) FILTER (below <= {CONFIDENCE} / (SELECT count(*) FROM counts)), -1) AS most FROM tails GROUP BY n),
chosen AS (
  SELECT stratum, rule, cutoff FROM counts JOIN most USING (n) WHERE k <= most AND caught - {COST} * k > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - {COST} * k DESC, cutoff) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (
         SELECT 1 FROM chosen c WHERE c.stratum IS NOT DISTINCT FROM j.stratum AND
           CASE c.rule WHEN 'symbols' THEN symbols WHEN 'dup_lines' THEN dup_lines WHEN 'repeats' THEN repeats ELSE word_length END >= c.cutoff) AS kept
FROM judged j""",
}

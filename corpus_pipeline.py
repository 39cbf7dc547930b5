"""A corpus pipeline of five stages: quality rules, language ID, near-dedup, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. `run` writes each stage's result as Parquet in the shared folder and reads it back for the next.

All stages take empty tables and further columns of any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinetrace.llm.language import language_filter
from kinetrace.llm.mixing import mix_documents
from kinetrace.llm.neardup import keep_one
from kinetrace.llm.packing import pack_documents
from kinetrace.llm.quality import quality_filter
from kinetrace.plans.shared import Scratch, stored

#: Jaccard similarity of 5-word shingles, in percent, from which near_dedup takes two documents as copies. The 85 of op2 is that query's own.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled rules of their language.

    Null and empty texts go (too few words); a null language is a stratum of its own; without labels only the base rule
    holds; equal rows are judged alike and all stay or go.
    """
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a null lang becomes the language told.

    Texts without letters go. The model is fitted on a bounded sample of docs that say their language; if none does, nothing can be told and all go.
    """
    return language_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked from NEAR_PERCENT: the smallest doc_id.

    Rows without doc_id or without words stay; rows that share a doc_id stay or go together.
    """
    return keep_one(docs, percent=NEAR_PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights in whole documents, in the order of its schedule: some are left out, some come twice.

    Texts without words are in no mix; null is a source like any other; equal rows are separate documents.
    """
    return mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place; a null or empty text is one piece, equal rows are separate documents."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as temp:  # a stage's rows are needed until the next has stored its own
        docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
        for name, stage in STAGES[:-1]:
            docs = temp.stored(stage(spark, docs, sf_dir), name)
            if before:
                temp.drop(before)
            before = name
        return stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])


#: Tokens by a library and seeded picks: SQL can't express the result. tests/llm has a brute-force version of each stage.
ORACLE_SQL = None

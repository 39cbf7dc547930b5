"""Vectors as integers, for methods whose results have to be exact: what is kept, how it is scaled, and where it is clamped."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.text import quoted

SCALE = 256


def whole(embedding: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def largest(dimensions: int, width: int) -> int:
    """Integers are clamped to this size either way, so that squared distances over all components, and squared gaps of sums over `width` of them, stay in 63 bits: 2^27 for 64 components."""
    return math.isqrt(2**62 // max(dimensions, width * width)) // 2


def integers(vectors: DataFrame, scale: int, *keys: str) -> DataFrame:
    """keys, values (array of longs, floor(scale * x)) of the vectors that are whole; others are dropped."""
    mine = vectors.select(*[quoted(k).alias(k) for k in keys], quoted("embedding").cast("array<double>").alias("_v"))
    return mine.filter(whole()).select(*keys, F.transform("_v", lambda x: F.floor(F.lit(float(scale)) * x)).alias("values"))


def clamped(bound: int) -> Column:
    return F.transform("values", lambda x: F.greatest(F.least(x, F.lit(bound)), F.lit(-bound)).cast("int"))

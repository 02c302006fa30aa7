"""Layouts of parts in a file: running ends, overlaps, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def place(parts: DataFrame, key: str, index: str, length: str) -> DataFrame:
    """Offsets of parts that stand one after the other; equal indices go by length."""
    w = Window.partitionBy(key).orderBy(index, length).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length).over(w), F.lit(0).cast("long"))
    return parts.select(key, index, F.col(length).alias("length"), start.alias("begin")).withColumn("end", F.col("begin") + F.col("length"))


def overlaps(parts: DataFrame, key: str, index: str, begin: str, end: str) -> DataFrame:
    """Whether each part begins before the largest end of the earlier ones."""
    w = Window.partitionBy(key).orderBy(begin, index, end).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("reach", F.max(end).over(w)).withColumn("overlaps", F.coalesce(F.col(begin) < F.col("reach"), F.lit(False)))


def outcome(parts: DataFrame, key: str, ok: str, missing: str, malformed: str, unchecked: str) -> DataFrame:
    """Per file the first that holds: missing > malformed > mismatch > unchecked > match."""
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    ladder = F.when(any_of(missing), "missing").when(any_of(malformed), "malformed").when(any_of(~F.col(ok)), "mismatch").when(any_of(unchecked), "unchecked").otherwise("match")
    return parts.groupBy(key).agg(ladder.alias("outcome"), F.count(F.lit(1)).alias("n_parts"))

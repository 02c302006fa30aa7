"""Evidence rows and their projections: one row per (asset, source), never merged into a score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import joined

LAYERS = ("manifest", "container", "mark", "blind")
STATUSES = ("present", "absent", "inconclusive", "not_applicable")


@dataclass(frozen=True)
class Source:
    """applies: to which assets; assess: a column struct(status, details). Both are expressions over the asset row."""

    name: str
    layer: str
    applies: Callable[[], Column]
    assess: Callable[[], Column]


def python_source(name: str, layer: str, applies: Callable[[], Column], value: Callable[[], Column], run: Callable[[object], tuple[str, str | None]]) -> Source:
    """A source in Python: run gets the value and returns (status, details). What it raises becomes an inconclusive status with the error's text, and never ends the job."""

    def one(x: object) -> tuple[str, str | None]:
        try:
            return run(x)
        except Exception as e:  # noqa: BLE001  whatever a source raises is its evidence
            return "inconclusive", f"source failed: {e}"

    def each(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in values], columns=["status", "details"], dtype=object)

    return Source(name, layer, applies, lambda: F.pandas_udf(each, "status string, details string")(value()))


def _assessed(s: Source, frame: DataFrame) -> Column:
    """assess as struct(status, details), whichever of the two it gives."""
    column = s.assess()
    kind = frame.select(column.alias("x")).schema["x"].dataType
    if isinstance(kind, T.StructType):
        return F.struct(F.coalesce(column["status"], F.lit("inconclusive")).alias("status"), column["details"].cast("string").alias("details"))
    return F.struct(F.coalesce(column, F.lit("inconclusive")).alias("status"), F.lit(None).cast("string").alias("details"))


def ordered(sources: list[Source], only: tuple[str, ...] = LAYERS) -> list[Source]:
    """The sources of the wanted layers, by layer; those of one layer as they were given."""
    return sorted((s for s in sources if s.layer in only), key=lambda s: LAYERS.index(s.layer))


def listing(spark, sources: list[Source]) -> DataFrame:
    return spark.createDataFrame([(LAYERS.index(s.layer), s.layer, s.name) for s in ordered(sources)], "layer_ord int, layer string, source string")


def _each(assets: DataFrame, sources: list[Source], keep: list[str], only: tuple[str, ...], details: bool) -> DataFrame:
    """keep and e: an array with a struct per source, in order."""
    wanted = ordered(sources, only)
    none = F.struct(F.lit("not_applicable").alias("status"), F.lit(None).cast("string").alias("details"))
    found = {f"source_{i}": F.when(F.coalesce(s.applies(), F.lit(False)), _assessed(s, assets)).otherwise(none) for i, s in enumerate(wanted)}
    row = lambda i, s: F.struct(
        F.lit(LAYERS.index(s.layer)).alias("layer_ord"), F.lit(i).alias("source_ord"), F.lit(s.layer).alias("layer"), F.lit(s.name).alias("source"),
        F.col(f"source_{i}.status").alias("status"), *([F.col(f"source_{i}.details").alias("details")] if details else []),
    )
    return assets.select(*keep, *[c.alias(n) for n, c in found.items()]).select(*keep, F.array(*[row(i, s) for i, s in enumerate(wanted)]).alias("e"))


def inspect(assets: DataFrame, sources: list[Source], key: str, only: tuple[str, ...] = LAYERS, details: bool = False) -> DataFrame:
    """Long evidence rows. Sources are pruned before the plan is built; all are expressions of one pass over the assets."""
    return _each(assets, sources, [key], only, details).select(key, F.explode("e").alias("e")).select(key, "e.*")


def summarised(assets: DataFrame, sources: list[Source], key: str, only: tuple[str, ...] = LAYERS) -> DataFrame:
    """summary(inspect(...)) without rows per source: an asset's statuses are counted where they stand, and one row per asset is shuffled."""
    number = lambda s: F.size(F.filter("e", lambda x: x["status"] == s)).alias(f"n_{s}")
    count = [number(s) for s in STATUSES]
    present = F.transform(F.filter("e", lambda x: x["status"] == "present"), lambda x: F.struct(x["layer_ord"].alias("layer_ord"), x["source_ord"].alias("source_ord"), x["source"].alias("source")))
    per = _each(assets, sources, [key], only, False).select(key, *count, present.alias("p"))
    x = per.groupBy(key).agg(*[F.sum(f"n_{s}").alias(f"n_{s}") for s in STATUSES], F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
    return x.select(key, *[f"n_{s}" for s in STATUSES], F.array_join(F.transform("p", lambda y: y["source"]), ",").alias("present"))


def matrixed(assets: DataFrame, sources: list[Source], key: str, only: tuple[str, ...] = LAYERS) -> DataFrame:
    """Assets x sources without rows per source: the least status name of each."""
    names = [s.name for s in ordered(sources, only)]
    per = _each(assets, sources, [key], only, False)
    return per.groupBy(key).agg(*[F.min(F.col("e")[i]["status"]).alias(n) for i, n in enumerate(names)])


def layers_counted(assets: DataFrame, sources: list[Source], key: str, only: tuple[str, ...] = LAYERS) -> DataFrame:
    """layer_counts(inspect(...)) with one aggregation per asset before the layers are counted."""
    wanted = sorted({s.layer for s in sources if s.layer in only}, key=LAYERS.index)
    hit = lambda layer: F.exists("e", lambda x: (x["layer"] == layer) & (x["status"] == "present"))
    per = _each(assets, sources, [key], only, False).groupBy(key).agg(*[F.bool_or(hit(layer)).alias(f"layer_{layer}") for layer in wanted])
    total = per.agg(F.count(F.lit(1)).alias("files"), *[F.count_if(f"layer_{layer}").alias(layer) for layer in wanted])
    return total.select("files", F.explode(F.array(*[F.struct(F.lit(layer).alias("layer"), F.col(layer).alias("n")) for layer in wanted])).alias("x")).select("x.layer", F.col("x.n").alias("files_with_present"), "files")


def summary(evidence: DataFrame, key: str) -> DataFrame:
    """A row per asset: counts per status, and the sources that are present in order."""
    count = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    present = F.array_sort(F.collect_list(F.when(F.col("status") == "present", F.struct("layer_ord", "source_ord", "source"))))
    return evidence.groupBy(key).agg(*count, F.array_join(F.transform(present, lambda x: x["source"]), ",").alias("present"))


def matrix(evidence: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Assets x sources; the worst case of several rows is the smallest status name."""
    return evidence.groupBy(key).pivot(column, values).agg(F.min("status"))


def layer_counts(evidence: DataFrame, key: str) -> DataFrame:
    return evidence.groupBy("layer").agg(F.count_distinct(F.when(F.col("status") == "present", F.col(key))).alias("files_with_present"), F.count_distinct(key).alias("files"))


def first_seen(rows: DataFrame, key: str, value: str, order: str, name: str = "codes") -> DataFrame:
    """Distinct values per key in the order in which they first appear."""
    firsts = rows.groupBy(key, value).agg(F.min(order).alias("at"))
    return firsts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]), ",").alias(name))


def resolve_codes(codes: DataFrame, key: str, code: str, vocabulary: DataFrame) -> DataFrame:
    """Status ladder over a file's codes: an unknown code or a mix of kinds is inconclusive, generative is present, else absent."""
    known = joined(codes.select(key, code).distinct(), vocabulary, code, "left")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    a = known.groupBy(key).agg(has(F.col("kind").isNull()).alias("unknown"), has(F.col("kind") == "generative").alias("generative"), has(F.col("kind") == "captured").alias("captured"))
    status = F.when(F.col("unknown"), "inconclusive").when(F.col("generative") & F.col("captured"), "inconclusive").when(F.col("generative"), "present").otherwise("absent")
    return a.select(key, status.alias("status"))


def notes(**conditions: tuple[Column, str]) -> Column:
    """The texts of the conditions that hold, in the order given."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in conditions.values()])), "; ")

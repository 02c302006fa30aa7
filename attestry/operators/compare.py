"""Runs compared: ground truth, snapshots, routes, baselines, survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, value text); nulls stay rows."""
    return rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select(key, "x.*")


def outer_compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, outcome, expected, got): missing, extra, differing or same."""
    a, b = left.select(key, F.col(value).alias("expected"), F.lit(True).alias("in_a")), right.select(key, F.col(value).alias("got"), F.lit(True).alias("in_b"))
    outcome = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(F.col("expected").eqNullSafe(F.col("got")), "same").otherwise("differing")
    return a.join(b, key, "full_outer").select(key, outcome.alias("outcome"), "expected", "got")


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Changed (field, old, new) with the number of files, over the files of both snapshots."""
    a = old.select(key, *[F.col(c).alias(f"old_{c}") for c in columns]).join(new.select(key, *columns), key)
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").cast("string").alias("old"), F.col(c).cast("string").alias("new")) for c in columns])
    changed = a.select(F.explode(F.filter(pairs, lambda p: ~p["old"].eqNullSafe(p["new"]))).alias("p"))
    return changed.groupBy("p.field", "p.old", "p.new").agg(F.count(F.lit(1)).alias("n"))


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with the side; as sets."""
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def route_pairs(rows: DataFrame, group: str, route: str, digest: str) -> DataFrame:
    """For each pair of routes a < b: in how many groups both stand, and in how many with one digest (the least of each)."""
    per = rows.groupBy(group, route).agg(F.min(digest).alias("d"))
    both = per.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(route).alias("r"), "d"))).alias("rs"))
    # routes are few: the pairs of one group are bounded by their number squared
    pairs = both.select(F.explode(F.flatten(F.transform("rs", lambda x: F.transform(F.filter("rs", lambda y: y["r"] > x["r"]), lambda y: F.struct(x["r"].alias("a"), y["r"].alias("b"), (x["d"] == y["d"]).alias("same")))))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("route_a"), F.col("p.b").alias("route_b")).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("p.same")).alias("n_same"))


def dedup(rows: DataFrame, digest: Column, order: str) -> DataFrame:
    """order, kept, is_kept: the first row of each digest is kept; null digests are kept all."""
    d = rows.select(order, digest.alias("digest"))
    firsts = d.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(order).alias("kept"))
    return d.join(firsts, "digest", "left").select(order, F.coalesce("kept", order).alias("kept"), (F.coalesce("kept", order) == F.col(order)).alias("is_kept"))


def longest_prefix(files: DataFrame, name: Column, prefixes: DataFrame, prefix: str, key: str) -> DataFrame:
    """(key, prefix): the longest prefix each name starts with, null if none. An equi-join per prefix length, not a theta join."""
    lengths = sorted(r[0] for r in prefixes.select(F.length(prefix)).distinct().collect())  # few lengths
    small = prefixes.select(F.col(prefix).alias("prefix")).distinct()
    cut = files.select(key, F.explode(F.array(*[F.when(F.length(name) >= n, F.substring(name, 1, n)) for n in lengths])).alias("prefix"))
    best = cut.join(small, "prefix").groupBy(key).agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix")).alias("x"))
    return files.select(key).join(best, key, "left").select(key, F.col("x.prefix").alias("prefix"))


def baseline_fate(rows: DataFrame, key: str, order: str, kind: Column) -> DataFrame:
    """Each row's kind against that of its key's first row: kept, lost, gained, changed or none."""
    own = rows.withColumn("kind", kind)
    first = own.groupBy(F.col(key).alias("base_key")).agg(F.min_by("kind", order).alias("base"), F.min(order).alias("base_at"))
    x = own.join(first, F.col(key) == F.col("base_key")).filter(F.col(order) > F.col("base_at"))
    fate = F.when(F.col("base").isNull() & F.col("kind").isNull(), "none").when(F.col("base").isNull(), "gained").when(F.col("kind").isNull(), "lost").when(F.col("base") == F.col("kind"), "kept").otherwise("changed")
    return x.withColumn("fate", fate)


def survival(rows: DataFrame, group: str, column: str, values: list[str], kept: Column) -> DataFrame:
    """group x column: the one outcome if unanimous, else kept/n."""
    k, n = F.count_if(kept), F.count(F.lit(1))
    cell = F.when(k == n, F.lit("all")).when(k == 0, F.lit("none")).otherwise(F.concat(k.cast("string"), F.lit("/"), n.cast("string")))
    return rows.groupBy(group).pivot(column, values).agg(cell)


def last_wins(rows: DataFrame, key: str, priority: str, values: list[str]) -> DataFrame:
    """One row per key: the values of the highest priority."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), priority).alias("x")).select(key, "x.*")


def first_rule(rows: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, rule): the first rule of the ordered table whose condition holds, null if none."""
    return rows.select(key, F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules]).alias("rule"))

"""Thresholds at a false-positive rate, rates at a threshold, and related statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: The distance from 1.0 to the next double; added to the threshold as it is, though it vanishes beyond 4.
EPSILON = 2.220446049250313e-16


#: Share of a group's values, on either side of a rank, among which it is looked for; and the sketch's accuracy (1 / ACCURACY of a group, at most).
BAND, ACCURACY = 0.002, 10_000
#: Groups up to so many rows are searched whole.
SMALL = 2_000
#: Groups up to which a table with a row per group is broadcast.
GROUPS = 100_000


def ranked_value(rows: DataFrame, groups: list[str], value: str, share: float, rank: Callable[[Column], Column]) -> DataFrame:
    """Per group: n, and x, the value of an ascending rank (from 0, as a function of n) that is near share * n; null beyond.

    A sketch per group gives bounds around the rank; values between them are counted one by one, those below only as a
    number, both with partial aggregation. So a hot group never is in one task: only its few values within the bounds are.
    """
    some = rows.filter(F.col(value).isNotNull()).select(*groups, value)
    cuts = [max(0.0, share - BAND), min(1.0, share + BAND)]
    bounds = some.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.percentile_approx(value, cuts, ACCURACY).alias("q"))
    whole = F.col("n") <= SMALL
    bounds = written(bounds.select(*groups, "n", F.when(whole, F.col("least")).otherwise(F.col("q")[0]).alias("low"), F.when(whole, F.col("most")).otherwise(F.col("q")[1]).alias("high")), "bounds")
    small = bounds.select(*[F.col(g).alias(f"group_{g}") for g in groups], "n", "low", "high")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"group_{g}")) for g in groups])
    near = some.join(F.broadcast(small) if bounds.count() <= GROUPS else small, same).filter(F.col(value) <= F.col("high"))
    per = near.groupBy(*groups, "n", F.when(F.col(value) >= F.col("low"), F.col(value)).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*groups).orderBy(F.col("x").asc_nulls_first()))
    found = per.withColumn("upto", upto).filter(F.col("upto") > rank(F.col("n"))).groupBy(*groups).agg(F.min("x").alias("x"))
    return bounds.select(*groups, "n").join(found.select(*[F.col(g).alias(f"group_{g}") for g in groups], "x"), same, "left").select(*groups, "n", "x")


def threshold_at_fpr(negatives: DataFrame, groups: list[str], value: str, fpr: float = 0.01) -> DataFrame:
    """Per group: the (floor(n * fpr) + 1)-th largest value plus EPSILON; infinite if there is none."""
    k = lambda n: F.floor(n * F.lit(float(fpr)))
    at = ranked_value(negatives, groups, value, 1.0 - fpr, lambda n: n - 1 - k(n))
    return at.select(*groups, "n", F.when(k(F.col("n")) < F.col("n"), F.col("x") + F.lit(EPSILON)).otherwise(F.lit(float("inf"))).alias("threshold"))


def rate_at(value: Column, threshold: Column) -> Column:
    """Aggregate: the fraction of values that reach the threshold; 0 for none."""
    return F.coalesce(F.avg(F.when(value >= threshold, F.lit(1.0)).otherwise(F.lit(0.0))), F.lit(0.0))


def upper_median(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Per group the element n // 2 of the sorted values, never an average of two."""
    return ranked_value(rows, groups, value, 0.5, lambda n: F.floor(n / 2)).select(*groups, F.col("x").alias("upper_median"), "n")


def top_mean(rows: DataFrame, groups: list[str], value: str, k: int = 3) -> DataFrame:
    """Mean of the k largest values, rounded to 9 places."""
    best = Window.partitionBy(*groups).orderBy(F.col(value).desc())
    top = rows.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    return top.groupBy(*groups).agg(F.round(F.avg(value), 9).alias("top_mean"), F.count(F.lit(1)).alias("n"))


def histogram_anomalies(bins: DataFrame, groups: list[str], position: str, count: str, reach: int = 3, least: int = 30) -> DataFrame:
    """Gaps (a bin below a quarter of the next ``reach`` bins' maximum) and spikes (above 2.5 times the last ones') among bins with enough neighbours."""
    w = Window.partitionBy(*groups).orderBy(position)
    out, inn = F.max(count).over(w.rowsBetween(1, reach)), F.max(count).over(w.rowsBetween(-reach, -1))
    x = bins.select(*groups, position, count, out.alias("outer"), inn.alias("inner"))
    gap = (F.col("outer") >= least) & (F.col(count) < F.col("outer") * F.lit(0.25))
    spike = (F.col("inner") >= least) & (F.col(count) > F.col("inner") * F.lit(2.5))
    return x.groupBy(*groups).agg(F.count_if(gap).alias("gaps"), F.count_if(spike).alias("spikes"), F.count_if((F.col("outer") >= least) | (F.col("inner") >= least)).alias("candidates"))

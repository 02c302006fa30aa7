"""Mixing sources to target weights.

Sizes (words [^\\x20\\x09-\\x0D]+) are summed per source, sources in code point order (null last)
weigh 1, 2, 3, 1, ...; targets share all words by weight, and no target passes ``cap`` times its
source's size: the excess is shared again by weight among the rest until none is above. A document is
then emitted floor(rate) times, rate = target / source size, plus once more if a hash of the seed and
its doc_id falls below the fraction of rate.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source
without words has target 0 and emits nothing; rows that repeat a doc_id draw alike; an empty table gives
an empty result; extra columns pass through, and added names get underscores in front if they clash.

Scale: two passes over the texts and one exchange of a row per source and task. The table of sources
(a row each) is joined by broadcast only if it was counted small. No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, join_measured, stored

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and doc_id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def source_targets(docs: DataFrame, cap: int = 3, weights: int = 3) -> DataFrame:
    """(source, source_size, target), a row per source.

    With sources ordered by cap * size / weight, those that end at their cap come first, so the level of
    the others follows from running sums: no rounds are needed.
    """
    per = docs.groupBy(F.col("source")).agg(F.sum(size_of(F.col("text"))).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.select("source", "source_size", ((rank - 1) % weights + 1).cast("double").alias("w")).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.select(
        "*",
        F.row_number().over(order).alias("i"),
        ((F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double") / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).alias("level"),
    )
    per = per.withColumn("free", F.col("most") / F.col("w") >= F.col("level"))
    level = F.min(F.when(F.col("free"), F.struct("i", "level"))).over(whole)
    per = per.withColumn("first", level)
    capped = F.col("first").isNull() | (F.col("i") < F.col("first.i"))
    return per.select("source", "source_size", F.when(capped, F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("first.level") * F.col("w"))).alias("target"))


def mix_plan(docs: DataFrame, cap: int = 3, weights: int = 3, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target and copies (long; how often the mix emits the row)."""
    table, _ = stored(source_targets(docs, cap, weights), "mix-sources")
    size, whole, target, copies, key = fresh(docs.columns, "size", "source_size", "target", "copies", "source_key")
    small = table.select(F.col("source").alias(key), F.col("source_size").alias(whole), F.col("target").alias(target))
    out = join_measured(docs.withColumn(size, size_of(F.col("text"))), small, F.col("source").eqNullSafe(F.col(key)), "inner", table.count()).drop(key)
    rate = F.when(F.col(whole) > 0, F.col(target) / F.col(whole)).otherwise(F.lit(0.0))
    base = F.floor(rate)
    return out.withColumn(copies, (base + F.when(draw(F.col("doc_id"), seed) < rate - base, 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, cap: int = 3, weights: int = 3, seed: int = 17) -> DataFrame:
    """The rows of docs as the mix has them: each as often as its copies say."""
    plan = mix_plan(docs, cap, weights, seed)
    copies = next(c for c in reversed(plan.columns))
    (one,) = fresh(plan.columns, "copy")
    return plan.filter(F.col(copies) > 0).withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM sized GROUP BY source
), run AS (
  SELECT *, 3 * source_size AS most, row_number() OVER o AS i,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER p, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
  FROM per
  WINDOW o AS (ORDER BY 3 * source_size / w ASC, source ASC NULLS LAST),
         p AS (ORDER BY 3 * source_size / w ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT min(i) AS i, min_by(level, i) AS level FROM run WHERE most / w >= level
), targets AS (
  SELECT source, source_size, CASE WHEN cut.i IS NULL OR run.i < cut.i THEN most::DOUBLE ELSE least(most::DOUBLE, cut.level * w) END AS target
  FROM run, cut
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))

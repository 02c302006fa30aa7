"""Connected components by smallest labels, with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for all ends of links (a, b): label is the smallest node that can be reached."""
    spark = links.sparkSession
    both, edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, path = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("hop"), F.col("label").alias("beyond"))
        step = step.join(far, F.col("label") == F.col("hop"), "left").select("node", "old", F.least("label", "beyond").alias("label"))
        step, new = stored(step, "labels")
        changed = step.filter(F.col("old") != F.col("label")).limit(1).count()
        discard(spark, path)
        labels, path = step.select("node", "label"), new
        if not changed:
            discard(spark, edges)
            return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links (a, b): only links between different components are walked."""
    spark = links.sparkSession
    at = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    own = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    between, path = stored(own.filter(F.col("a") != F.col("b")).distinct(), "between")
    if not between.limit(1).count():
        discard(spark, path)
        return labels
    more = components(between)  # its nodes are labels, or nodes that had none
    moved = more.select(F.col("node").alias("was"), F.col("label").alias("now"))
    old = labels.join(moved, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label"))
    out, _ = stored(old.unionByName(more.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")
    discard(spark, path)
    return out

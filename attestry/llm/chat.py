"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation, the dialogue is rendered with that speaker as ``assistant`` and all
others as ``user`` with their names; the mask is 1 on the characters the model has to say (the body and end
tag of the assistant's turns), 0 elsewhere. A rendering is a sequence of segments of ``SEGMENT`` turns each: their
texts in order of segment, joined by nothing, are the whole rendering, and ``begin`` and the mask's spans count
characters of the whole. So a conversation of any length is never gathered in one task; only SEGMENT rows are.
``whole`` joins the segments of renderings that fit a row.

Defined cases: turns stand in order of their number, then of role and text, and repeated rows are kept; a null
role is the participant "unknown", a null text is empty, a null turn counts as -1 and comes first; rows without a
conv_id form a conversation of their own; a participant who is named like another's role is the same
participant; an empty table gives an empty result; extra columns are not read.

Scale: the turns are sorted once by range, so a hot conversation, or one number that a third of all turns have, is
split over many tasks; each numbers its rows. Only conversations cut by a partition's end need the count of
earlier partitions: a row per partition at most, which is broadcast. The renderings of a segment are built from
one array, and the lengths that place a segment in its rendering are summed from a row per segment and role.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

SEGMENT = 256

_OWN, _USER, _NAMED, _END = "<|assistant|>\n", "<|user name=", "|>\n", "<|end|>\n"
NUMBERED = "conv_id long, turn long, role string, text string, part int, i long"


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, role, text and the place of each turn in its conversation, from 0."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, null = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
            new[0] = last != (bool(null[0]), int(key[0]))
            at = np.arange(len(key))
            start = np.maximum.accumulate(np.where(new, at, -1))
            i = np.where(start < 0, at + n, at - start)
            last, n = (bool(null[-1]), int(key[-1])), int(i[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(len(key), part, np.int32)), pa.array(i)], names=["conv_id", "turn", "role", "text", "part", "i"])

    # Equal rows are alike; the last key only spreads them over partitions.
    order = ["conv_id", "turn", "role", "text", "tie"]
    rows, _ = stored(t.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, NUMBERED), "turns")
    counts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.withColumn("before", before).filter(F.col("before") > 0).select(F.col("conv_id").alias("key"), F.col("part").alias("p"), "before")
    joined = rows.join(F.broadcast(earlier), F.col("conv_id").eqNullSafe(F.col("key")) & (F.col("part") == F.col("p")), "left")
    return joined.select("conv_id", "role", "text", (F.col("i") + F.coalesce("before", F.lit(0))).alias("place"))


def perspectives(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, speaker, segment, begin, n_turns, text, mask): begin is the first character's place in the whole rendering, mask an array of [begin, end) spans of it to learn."""
    t = _numbered(turns).withColumn("segment", F.floor(F.col("place") / segment).cast("long"))
    # A row per segment and role: what the segment's text is longer or shorter for that speaker.
    named = F.length("role") + len(_USER) + len(_NAMED)
    per = t.groupBy("conv_id", "segment", "role").agg(F.sum(named + F.length("text") + len(_END)).alias("size"), F.sum(F.lit(len(_OWN)) - named).alias("more"))
    speakers = per.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("speakers"))
    sizes = per.groupBy("conv_id", "segment").agg(F.sum("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("role", "more"))).alias("more"))
    same = lambda a, b: a.join(b.withColumnRenamed("conv_id", "key"), F.col("conv_id").eqNullSafe(F.col("key"))).drop("key")
    own = F.col("size") + F.coalesce(F.element_at("more", F.col("speaker")), F.lit(0))
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    begins = same(sizes, speakers).withColumn("speaker", F.explode("speakers")).select("conv_id", "segment", "speaker", F.coalesce(F.sum(own).over(earlier), F.lit(0)).cast("long").alias("begin"))
    begins = begins.groupBy(F.col("conv_id").alias("key"), F.col("segment").alias("part")).agg(F.array_sort(F.collect_list(F.struct("speaker", "begin"))).alias("starts"))
    parts = t.groupBy("conv_id", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    rotated = parts.join(begins, F.col("conv_id").eqNullSafe(F.col("key")) & (F.col("segment") == F.col("part"))).withColumn("start", F.explode("starts")).select("conv_id", "segment", "turns", "start.speaker", "start.begin")
    head = lambda x: F.when(x["role"] == F.col("speaker"), F.lit(_OWN)).otherwise(F.concat(F.lit(_USER), x["role"], F.lit(_NAMED)))
    pieces = F.transform("turns", lambda x: F.struct((x["role"] == F.col("speaker")).alias("own"), head(x).alias("head"), F.concat(x["text"], F.lit(_END)).alias("body")))
    rotated = rotated.withColumn("pieces", pieces)
    spans = F.aggregate(
        "pieces",
        F.struct(F.col("begin").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(p["own"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("begin"), (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return rotated.select("conv_id", "speaker", "segment", "begin", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"), spans.alias("mask"))


def whole(segments: DataFrame) -> DataFrame:
    """(conv_id, speaker, n_turns, text, mask): the renderings in one row each, for conversations that one row can hold."""
    parts = segments.groupBy("conv_id", "speaker").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("segment", "text", "mask"))).alias("parts"))
    return parts.select("conv_id", "speaker", "n_turns", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"), F.flatten(F.transform("parts", lambda x: x["mask"])).alias("mask"))


def op3_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    out = perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    first = F.coalesce(F.element_at("mask", F.when(F.size("mask") > 0, F.lit(1)))["begin"], F.lit(-1)).cast("long")
    return out.select("conv_id", "speaker", "segment", "begin", "n_turns", F.length("text").cast("long").alias("n_chars"), F.size("mask").cast("long").alias("n_masked_turns"), masked.alias("n_masked_chars"), first.alias("first_masked_char"), F.md5("text").alias("text_md5"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -1)::BIGINT AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), n AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM t
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t
), p AS (
  SELECT n.conv_id, speaker, place, place // 256 AS segment, role = speaker AS own,
    CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || role || '|>' || chr(10) END AS head,
    text || '<|end|>' || chr(10) AS body
  FROM n JOIN speakers s ON n.conv_id IS NOT DISTINCT FROM s.conv_id
), q AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY place) AS stop FROM p
)
SELECT conv_id, speaker, segment::BIGINT AS segment, min(stop - length(head) - length(body))::BIGINT AS "begin", count(*)::BIGINT AS n_turns, sum(length(head) + length(body))::BIGINT AS n_chars,
  count(*) FILTER (WHERE own)::BIGINT AS n_masked_turns, coalesce(sum(length(body)) FILTER (WHERE own), 0)::BIGINT AS n_masked_chars,
  coalesce(min(stop - length(body)) FILTER (WHERE own), -1)::BIGINT AS first_masked_char, md5(string_agg(head || body, '' ORDER BY place)) AS text_md5
FROM q GROUP BY conv_id, speaker, segment
"""

"""Inspection of files as they land in a folder, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evidence import Source, inspect
from ..sources.files import assets


def landing(spark: SparkSession, path: str, files_at_once: int = 1_000) -> DataFrame:
    """A stream of assets: a row per new file, with the time it was written."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(path)
    times = raw.select("modificationTime", F.struct("path", "content").alias("f"))
    return assets(times.select(F.col("f.path").alias("path"), F.col("f.content").alias("content"), "modificationTime"), keep=("modificationTime",))


def distinct_content(found: DataFrame, within: str = "1 day") -> DataFrame:
    """The first file of each content among those written within the time; the state is bounded by the watermark."""
    return found.withWatermark("modificationTime", within).dropDuplicatesWithinWatermark(["sha256"])


def write_evidence(found: DataFrame, sources: list[Source], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Evidence of the supported assets, appended as Parquet; a restart goes on where the checkpoint stands."""
    rows = inspect(found.filter(F.col("skip_reason").isNull()), sources, "path", details=True)
    out = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()

"""Written tables that cut a plan's lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a counted side is broadcast; rows of lookup tables are some hundred bytes.
BROADCAST_ROWS = 200_000


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the folder that spark.checkpoint.dir names, read again: it survives lost executors. The folder's owner cleans it."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "attestry-tables")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined(big: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str) -> DataFrame:
    """A join whose small side is broadcast only if it was counted as small; else both are shuffled, and hot keys are split at run time."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small, on, how)

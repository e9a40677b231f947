"""Leak screening of a stream of texts: a stateless projection, so it runs as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnloom.functions import leak


def screened(texts: DataFrame) -> DataFrame:
    """texts(path, text) with their reasons; rows without any are left out.  Batch or stream."""
    return texts.withColumn("reasons", leak.reasons(F.col("path"), F.col("text"))).where(F.size("reasons") > 0)


def screen(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what is found to Parquet; reruns go on from the checkpoint and process what is new."""
    return screened(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

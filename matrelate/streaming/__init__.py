"""Accumulating matrices from streams of triplets.

The iterations of this library are driver loops, not streams.  What a stream
can do here is feed a matrix: triplets that arrive over time are summed by
coordinate, which is what building a matrix from a list does.  Each micro-batch
is summed and stored as a folder of its own, so a batch that is run again after
a failure replaces itself, and neither the driver nor the state store holds the
matrix; reading adds the batches up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _summed(df: DataFrame) -> DataFrame:
    values = [c for c in df.columns if c in ("v", "re", "im")]
    return df.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in values])


def accumulate(triplets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store the sums of a stream of (i, j, v) or (i, j, re, im) under ``path``, one folder a micro-batch."""

    def store(batch: DataFrame, number: int) -> None:
        _summed(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return triplets.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).start()


def accumulated(spark: SparkSession, path: str) -> DataFrame:
    """The running sums so far."""
    return _summed(spark.read.parquet(path))

"""Two-pass external shuffle of a corpus into shards of equal row counts.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash
of id and text, one bucket a task.  Pass two orders each bucket by its key (an external sort, so a
bucket larger than memory spills instead of failing), deals its rows out by a
seeded Fisher-Yates permutation of the bucket's positions, and lays the
buckets end to end.  Shards are contiguous ranges of that global order whose
row counts differ by at most one.

Defined results: a null text counts as no bytes; rows with null or repeated
ids are scattered by their texts; rows equal in id and text are separate
records of one bucket, in any order; the same rows, seed and bucket count give
the same order however the input is split;
an empty table gives an empty result; input columns stay inside the struct
``record``, so they cannot clash with ``shard`` and ``slot``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, shuffle_partitions

#: Bytes charged for a record besides its text.
RECORD_BYTES = 16


def shuffle_into_shards(
    df: DataFrame,
    n_shards: int,
    seed: int = 20240517,
    bucket_bytes: int = 64 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row of ``df`` as ``record`` with its ``shard`` and ``slot``.

    The same seed, rows and bucket count give the same order.  The driver
    holds one count per bucket, that is input bytes / ``bucket_bytes`` numbers.
    """
    spark = df.sparkSession
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + RECORD_BYTES
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("b")).first()
    n_rows = total["n"]
    n_buckets = max(shuffle_partitions(spark), -(-(total["b"] or 0) // bucket_bytes))

    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(n_buckets)).cast("int")
    counts = np.zeros(n_buckets, np.int64)
    for row in df.select(bucket.alias("b")).groupBy("b").count().toLocalIterator():
        counts[row["b"]] = row["count"]
    starts = np.concatenate([[0], np.cumsum(counts)])
    bounds = np.array([n_rows * s // n_shards for s in range(n_shards + 1)], np.int64)
    tables = spark.sparkContext.broadcast((counts, starts, bounds))

    scattered = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), bucket.alias("bucket"))
    order = [F.col("bucket"), F.col(f"record.`{id_col}`"), F.xxhash64(F.col(f"record.`{text_col}`"))]
    # by the number itself: hashed numbers would leave tasks empty and give others several buckets
    scattered = scattered.repartitionById(n_buckets, "bucket").sortWithinPartitions(*order)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, starts, bounds = tables.value
        at, used, perm = -1, 0, None
        for batch in batches:
            buckets = batch.column(1).to_numpy(zero_copy_only=False)
            place = np.empty(len(buckets), np.int64)
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(buckets)]):
                if lo == hi:
                    continue
                if buckets[lo] != at:
                    at, used = int(buckets[lo]), 0
                    perm = np.random.Generator(np.random.PCG64([seed, at])).permutation(counts[at])
                place[lo:hi] = starts[at] + perm[used : used + hi - lo]
                used += hi - lo
            shard = np.searchsorted(bounds, place, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shard.astype(np.int32)), pa.array(place - bounds[shard])], ["record", "shard", "slot"]
            )

    schema = T.StructType([scattered.schema["record"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return map_batches(scattered, deal, schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; a bucket touches at most a few neighbouring shards, so files stay few."""
    sharded.write.partitionBy("shard").parquet(path)

"""Exact deduplication on a log-structured index of text digests.

A memtable is one input split: each task digests its rows, sorts them and
flushes them as a run file with a Bloom filter on the digest.  Compaction
merges runs into one sorted level with one entry per digest, keeping the
smallest (or largest) identifier and the number of rows.  A digest that occurs
more than once is a hit; hits are verified byte for byte by grouping on the
text itself, and texts that merely share a digest are kept apart.

Only built-in DataFrame functions run here.  The digest column is the one
thing that is shuffled for all rows; texts move for hits only, and equal texts
are merged before they move, so a group of copies of any size costs one row
per task.

Defined results: null text counts as empty text; an empty table gives an empty
result; a null id never wins against a known one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path

#: Digests hardly repeat in a file, and a dictionary would take the Bloom filter's place.
FILES = {
    "compression": "zstd",
    "parquet.bloom.filter.enabled#digest": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.enable.dictionary#digest": "false",
}
#: Hit digests up to this number are broadcast as a filter (40 bytes each); above it the texts are joined by a shuffle.
BROADCAST_HITS = 500_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Runs and levels of (digest, id, n) under one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "min", digest=sha256):
        self.spark, self.keep, self.digest = spark, {"min": F.min, "max": F.max}[keep], digest
        self.path = path or scratch_path(spark, "digests")
        self.runs: list[str] = []
        self.level: str | None = None
        self.writes = 0

    def _write(self, df: DataFrame, name: str) -> str:
        self.writes += 1
        path = f"{self.path}/{name}-{self.writes}"
        df.write.options(**FILES).parquet(path)
        return path

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Write one sorted run file per input split; returns the flushed entries (digest, id)."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        entries = docs.select(self.digest(text).alias("digest"), F.col(id_col).alias("id")).sortWithinPartitions("digest")
        self.runs.append(self._write(entries, "run"))
        return self.spark.read.parquet(self.runs[-1])

    def compact(self) -> DataFrame:
        """Merge all runs and the present level to a new level; one entry per digest: digest, id, n."""
        parts = [self.spark.read.parquet(p).select("digest", "id", F.lit(1).cast("long").alias("n")) for p in self.runs]
        if self.level:
            parts.append(self.spark.read.parquet(self.level))
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.unionByName(p)
        merged = merged.groupBy("digest").agg(self.keep("id").alias("id"), F.sum("n").alias("n")).sortWithinPartitions("digest")
        self.level = self._write(merged, "level")
        self.runs = []
        return self.entries()

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(self.level)

    def find(self, texts: list[str]) -> DataFrame:
        """Entries of a few given texts, from runs and level alike; files whose sorted range or filter excludes them are skipped."""
        probe = self.spark.createDataFrame([(t,) for t in texts], "text string").select(self.digest(F.col("text")).alias("d"))
        wanted = F.col("digest").isin([bytes(r["d"]) for r in probe.collect()])
        parts = [self.spark.read.parquet(p).where(wanted).select("digest", "id") for p in [*self.runs, *([self.level] if self.level else [])]]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        return found

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """For each row of a new batch whether its digest is indexed, and under which id; the batch is not added."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        probe = docs.select(F.col(id_col).alias("doc_id"), self.digest(text).alias("digest"))
        return probe.join(self.entries(), "digest", "left").select("doc_id", "digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))


def deduplicate(docs: DataFrame, keep: str = "min", digest=sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept.

    ``keep`` says whether the smallest or the largest id of equal texts stays.
    Of rows that share the winning id, all are marked kept.
    """
    return _resolve(docs, keep, digest, id_col, text_col)[1]


def _resolve(docs: DataFrame, keep: str, digest, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The flushed entries (digest, id), and the result of ``deduplicate``."""
    spark = docs.sparkSession
    index = DigestIndex(spark, keep=keep, digest=digest)
    flushed = index.flush(docs, id_col, text_col)
    level = index.compact()

    hits = level.where("n > 1").select("digest")
    bounded = hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    text = F.coalesce(F.col(text_col), F.lit(""))
    hit_texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), digest(text).alias("digest")).join(
        F.broadcast(hits) if bounded else hits, "digest", "left_semi"
    )
    verified = hit_texts.groupBy("digest", "text").agg(index.keep("id").alias("id"), F.count(F.lit(1)).alias("n"))
    clashing = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    clash_path = scratch_path(spark, "clashes")
    clashing.write.parquet(clash_path)
    clashing = spark.read.parquet(clash_path)

    found = flushed.withColumnRenamed("id", "doc_id").join(level, "digest")
    if not clashing.isEmpty():
        apart = hit_texts.withColumnRenamed("id", "doc_id").join(clashing, "digest", "left_semi").join(verified, ["digest", "text"])
        found = found.join(clashing, "digest", "left_anti").select("doc_id", "digest", "id", "n").unionByName(apart.select("doc_id", "digest", "id", "n"))
    return flushed, found.select(
        "doc_id",
        "digest",
        F.col("id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("id")).alias("kept"),
    )


def drop_duplicates(docs: DataFrame, keep: str = "min", digest=sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each distinct text; of rows equal in id and text any one stays."""
    flushed, found = _resolve(docs, keep, digest, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col(id_col).alias("id"), digest(text).alias("digest"))

    def among(left: DataFrame, side: DataFrame, how: str) -> DataFrame:
        return left.join(side, left["id"].eqNullSafe(side["other_id"]) & (left["digest"] == side["other_digest"]), how)

    # no aggregation above the join on digests, so that Spark may split the partition of a large group
    lost = found.where(~F.col("kept")).select(F.col("doc_id").alias("other_id"), F.col("digest").alias("other_digest"))
    left = among(rows, lost, "left_anti")
    repeated = flushed.groupBy(F.col("id").alias("other_id"), F.col("digest").alias("other_digest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if repeated.isEmpty():
        return left.select("record.*")
    once = among(left, repeated, "left_anti").select("record")
    return once.unionByName(among(left, repeated, "left_semi").dropDuplicates(["id", "digest"]).select("record")).select("record.*")

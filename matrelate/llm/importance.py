"""Quality selection by importance resampling.

Two generative models over hashed unigrams and bigrams are counted: one over
target texts (labelled good), one over all raw texts.  A document's importance
is the log ratio of their likelihoods.  Adding Gumbel noise and keeping the k
largest samples k documents without replacement in proportion to importance.

The raw model counts every document.  The target model reads at most about
``TARGET_DOCS`` labelled rows.  Both are vectors of ``BUCKETS`` numbers.  The
k-th largest key is found exactly by refining histograms, so neither a global
sort nor a collect of all keys is needed.

Defined results: null and empty texts have importance 0; a row whose key ties
with the k-th stays, so ties may keep more than k; labels without a document
and repeated labels change nothing; rows with a null id get noise of their own
id's hash, that is all the same; without target rows every importance is 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, caches, map_batches, materialize, raw_texts

#: Of 10,000, 100,000 and 1,000,000, the number that told toxic from clean held-out texts best.
BUCKETS = 100_000
TARGET_DOCS = 200_000
REPEATED = np.uint64(1)
#: Histogram bins of one refinement, and the keys that are finally compared one by one.
BINS, LAST = 4096, 10_000
_TOKENS = re.compile(rb"[0-9a-z\x80-\xff]+|[^\x00-\x200-9a-z\x80-\xff]+")


_hashes = WordHashes()
caches[__name__] = _hashes.clear


def features(text: bytes | None) -> np.ndarray:
    """Buckets of the text's unigrams, then bigrams; words and runs of other signs are tokens.

    A token after itself is one and the same bigram whatever the token.
    """
    tokens = _TOKENS.findall(text.translate(LOWER)) if text else []
    h = _hashes.of(tokens)
    both = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both[h[:-1] == h[1:]] = REPEATED
    both ^= both >> np.uint64(29)
    return (np.concatenate([h, both]) % np.uint64(BUCKETS)).astype(np.int64)


def fit(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of target to raw probability per bucket.  ``target_ids`` has one column of ids."""
    ids = target_ids.toDF("target").where("target is not null").distinct()
    n = ids.count()
    if n > TARGET_DOCS:
        ids = ids.where(F.pmod(F.xxhash64(F.lit(5), "target"), F.lit(1 << 30)) < int((1 << 30) * TARGET_DOCS / n))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), F.col("id") == F.col("target"), "left")
    rows = rows.select("text", F.col("target").isNotNull().alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            got = [features(text) for text in raw_texts(batch.column(0))]
            for k, of in enumerate((got, [f for f, is_target in zip(got, batch.column(1).to_pylist()) if is_target])):
                if of:
                    total[k] += np.bincount(np.concatenate(of), minlength=BUCKETS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], names=["b", "raw", "target"])

    sums = map_batches(rows, count, "b long, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x: (x + 1) / (x.sum() + BUCKETS)
    return np.log(share(target) / share(raw))


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows doc_id, n_features, log_weight and the Gumbel key, for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t) for t in raw_texts(batch.column(1))]
            weights = [float(shared.value[f].sum()) for f in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in got], pa.int64()), pa.array(weights, pa.float64())], names=["doc_id", "n_features", "log_weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = map_batches(rows, run, "doc_id long, n_features long, log_weight double")
    even = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    return materialize(scored.withColumn("key", F.col("log_weight") - F.log(-F.log(even))), "importance")


def kth_largest(keys: DataFrame, k: int, column: str = "key") -> float:
    """The k-th largest value, exactly; -inf if k covers all rows."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return -math.inf
    if k <= 0:
        return math.inf
    inside, above = keys.select(F.col(column).alias("v")), 0
    while n > LAST and low < high:
        width = (high - low) / BINS
        bin_of = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1))
        bins = inside.groupBy(bin_of.alias("b")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(bins, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                inside, n, low, high = inside.where((F.col("v") >= r["lo"]) & (F.col("v") <= r["hi"])), r["n"], r["lo"], r["hi"]
                break
            above += r["n"]
    if low == high:
        return low
    return sorted((r["v"] for r in inside.collect()), reverse=True)[k - above - 1]


def resample(docs: DataFrame, target_ids: DataFrame, keep: float, seed: int = 11) -> DataFrame:
    """Every document with its importance; ``kept`` marks the sample of the share ``keep`` of all documents."""
    weighed = weigh(docs, fit(docs, target_ids), seed)
    limit = kth_largest(weighed, math.ceil(keep * weighed.count()))
    return weighed.withColumn("kept", F.col("key") >= limit)

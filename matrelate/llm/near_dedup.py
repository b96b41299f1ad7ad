"""Near-duplicate detection by one-permutation MinHash with exact confirmation.

1. Every text becomes a set of hashed word shingles.  Rows with equal sets form
   a class; all further work is on classes, so a group of copies of any size is
   one class.
2. One permutation: the hash space is cut into bins and a set's smallest hash
   in each bin is its signature; empty bins borrow from a bin drawn by a hash
   of (bin, attempt), the same for all sets (optimal densification).
3. Bands of the signature are buckets.  A bucket gives star-shaped candidates:
   its first class against each other member, so their number is linear.
4. Candidates are confirmed on the full sets, and confirmed links contracted to
   components.
5. A star can miss a link between two members that the centre is not linked
   with.  Buckets of three and more that still hold several components are
   therefore completed: members of different components are compared, best
   signatures first, and components that become one are not compared further.
   Pairs are weighed inside the task and never emitted; large buckets are split
   into blocks of bounded size.

A pair at similarity 0.8 misses all buckets with probability 5e-8.

Defined results: null and empty texts, and texts without words, have an empty
set, no links, and are kept; texts of fewer words than a shingle are one
shingle; a null id never names a component unless all ids of it are null;
repeated ids and rows are judged row by row; columns other than id and text
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, caches, map_batches, materialize, mix64, passing, raw_texts, small, unbroadcast, without
from .components import Forest, connected_components
from .exact_dedup import sha256

BINS = 128
BAND_ROWS = 4
BANDS = BINS // BAND_ROWS
#: A bucket of more shingle hashes than this is compared in blocks; their number grows with the root of the bucket's size.
BLOCK_HASHES = 50_000
#: Signature agreement below which a pair is not confirmed: over five standard deviations under the threshold.
MARGIN = 0.2

_hashes = WordHashes()
caches[__name__] = _hashes.clear
_STEP = np.uint64(0x9E3779B97F4A7C15)

ROW_SCHEMA = "doc_id long, digest binary, n_shingles long, class binary, bands array<long>"
SET_SCHEMA = "class binary, signature binary, hashes binary"


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    found = text.translate(LOWER).split() if text else []
    h = _hashes.of(found)
    n = len(h)
    if n > size:
        total = h[: n - size + 1].copy()
        for k in range(1, size):
            total = total * _STEP + h[k : n - size + 1 + k]
    elif n:
        total = h[:1].copy()
        for k in range(1, n):
            total = total * _STEP + h[k : k + 1]
    else:
        return h
    return np.unique(mix64(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of bin minima per (non-empty) set."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    out = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for k, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        full[k] = np.diff(at, append=len(s)) > 0
        out[k] = s[np.minimum(at, len(s) - 1)]
    row, bin_ = np.nonzero(~full)
    attempt = 0
    while len(row):
        attempt += 1
        other = (mix64(bin_.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        found = full[row, other]
        out[row[found], bin_[found]] = out[row[found], other[found]]
        row, bin_ = row[~found], bin_[~found]
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One bucket number per band, the band's number mixed in."""
    parts = signature.reshape(len(signature), BANDS, BAND_ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND_ROWS):
        total = mix64(total * _STEP + parts[:, :, k])
    return total.view(np.int64)


def _class(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sign(docs: DataFrame, size: int, id_col: str, text_col: str, digest: Column | None = None) -> DataFrame:
    """Stored rows: doc_id, digest (null unless given), n_shingles, class (null for an empty set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(1))
            for lo in range(0, len(texts), 1024):
                sets = [shingle_set(t, size) for t in texts[lo : lo + 1024]]
                some = [k for k, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                if some:
                    for k, b in zip(some, band_hashes(signatures([sets[k] for k in some]))):
                        bands[k] = b
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(sets)),
                        batch.column(2).slice(lo, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_class(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "digest", "n_shingles", "class", "bands"],
                )

    known = F.lit(None).cast("binary") if digest is None else digest
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), known.alias("digest"))
    return materialize(map_batches(rows, run, ROW_SCHEMA), "signed")


def _sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Stored full sets of the wanted classes, from the rows whose id represents them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(0))
            for lo in range(0, len(texts), 512):
                sets = [s for s in (shingle_set(t, size) for t in texts[lo : lo + 512]) if len(s)]
                if sets:
                    marks = (signatures(sets) >> np.uint64(20)).astype(np.uint16)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_class(s) for s in sets]), pa.array([m.tobytes() for m in marks]), pa.array([s.tobytes() for s in sets])],
                        names=["class", "signature", "hashes"],
                    )

    # one long that is never null keeps the driver's hash table small; rows whose ids share one are sorted out by their classes
    rep = small(wanted.select(F.xxhash64("rep").alias("wanted")).distinct())
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long")).alias("key"), F.col(text_col).alias("text"))
    rows = rows.join(rep, F.col("key") == F.col("wanted"), "left_semi").select("text")
    found = map_batches(rows, run, SET_SCHEMA).join(wanted.select("class").distinct(), "class", "left_semi")
    return materialize(found.groupBy("class").agg(F.min("signature").alias("signature"), F.min("hashes").alias("hashes")), "sets")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def _confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """Links among rows (a, b, a_hashes, b_hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(k).to_pylist() for k in (2, 3))
            good = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good)) for k in (0, 1)], names=["a", "b"])

    return map_batches(pairs, run, "a binary, b binary")


def _complete_block(members: list[dict], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between members of different components that are needed to join these.

    Members carry side 0 or 1; with both sides present only pairs across are
    compared, as pairs within a side have a block of their own.
    """
    sets = [np.frombuffer(m["hashes"], np.uint64) for m in members]
    marks = np.stack([np.frombuffer(m["signature"], np.uint16) for m in members])
    sizes = np.array([len(s) for s in sets])
    side = np.array([m["side"] for m in members])
    labels = [m["label"] for m in members]
    kinds = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    kind = np.array([kinds[x] for x in labels])
    # the largest component is compared from its outside only
    largest = np.bincount(kind).argmax()
    rows = np.flatnonzero(kind != largest)
    forest, links = Forest(), []
    mixed = len(set(side.tolist())) > 1
    for i in rows.tolist():
        other = kind != kind[i]
        other &= (kind == largest) | (np.arange(len(members)) > i)
        other &= (100 * np.minimum(sizes, sizes[i])) >= percent * np.maximum(sizes, sizes[i])
        if mixed:
            other &= side != side[i]
        js = np.flatnonzero(other)
        if not len(js):
            continue
        agree = (marks[js] == marks[i]).mean(axis=1)
        order = np.argsort(-agree, kind="stable")
        for j in js[order[agree[order] >= percent / 100 - MARGIN]].tolist():
            a, b = int(kind[i]), int(kind[j])
            if forest.root(a) != forest.root(b) and _similar(sets[i], sets[j], percent):
                forest.unite(a, b)
                links.append((members[i]["class"], members[j]["class"]))
    return links


def _complete(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the stars missed, from buckets that still hold several components."""
    labelled = members.join(roots, members["class"] == roots["node"], "left").select("bucket", "class", "n", F.coalesce("root", "class").alias("label"))
    # a member is sent to every block, so blocks grow with the root of the bucket
    blocks = F.ceil(F.sqrt(F.sum("n") / BLOCK_HASHES)).cast("int")
    # two 64-bit sums over the members' hashes tell member lists apart
    both = F.struct(*[F.sum(F.xxhash64(F.lit(seed), "class").cast("decimal(20,0)")) for seed in (1, 2)])
    mixed = (
        labelled.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("l"), F.max("label").alias("h"), blocks.alias("blocks"), both.alias("members"))
        .where("size > 2 and l <> h")
        # bands often gather the very same members; one of such buckets is enough
        .groupBy("size", "members")
        .agg(F.min(F.struct("bucket", "blocks")).alias("one"))
        .select("one.bucket", "one.blocks")
    )
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    placed = labelled.join(mixed, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "class", "label", (F.col("own") > F.col("other")).cast("int").alias("side")
    ).join(sets, "class")
    key = ["bucket", "low", "high"]
    placed = placed.repartition(*key).sortWithinPartitions(*key, "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist())
        for _, group in groupby(rows, key=lambda r: (r["bucket"], r["low"], r["high"])):
            links = _complete_block(list(group), percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links]), pa.array([y for _, y in links])], names=["a", "b"])

    return map_batches(placed, run, "a binary, b binary").distinct()


def find_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id of its group), kept."""
    rows, named = _resolve(docs, size, percent, id_col, text_col)
    named = named.select("class", F.col("one.doc_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each group: that of the smallest id, and of equal ids that of the smallest digest.

    Rows are told apart by id and text, so null and repeated ids lose the
    judged rows only; of rows equal in both any one stays.
    """
    rows, named = _resolve(docs, size, percent, id_col, text_col, sha256(F.coalesce(F.col(text_col), F.lit(""))))
    judged = rows.select("doc_id", "digest", "class").join(named, "class")
    first = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("digest") == F.col("one.digest"))
    # only classes of several rows can hold one row twice
    judged = materialize(judged.select("doc_id", "digest", "copies", first.alias("first")).where("not first or copies > 1"), "judged")
    key = ["doc_id", "digest"]
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col(id_col).cast("long").alias("doc_id"), sha256(F.coalesce(F.col(text_col), F.lit(""))).alias("digest")
    )
    left = without(source, judged.where("not first").select(*key).distinct(), key)
    repeated = materialize(judged.where("first").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key), "repeated")
    if repeated.isEmpty():
        return left.select("record.*")
    once = without(left, repeated, key).select("record")
    several = repeated.select(*[F.col(c).alias(f"other_{c}") for c in key])
    again = left.join(several, F.col("doc_id").eqNullSafe(F.col("other_doc_id")) & (F.col("digest") == F.col("other_digest")), "left_semi")
    return once.unionByName(again.dropDuplicates(key).select("record")).select("record.*")


def _resolve(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, digest: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and per class: the number of its rows (copies) and the first row of its group (one: doc_id, digest)."""
    rows = sign(docs, size, id_col, text_col, digest)
    # equal sets have equal signatures, so any row's will do
    classes = rows.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("rep"),
        F.min("n_shingles").alias("n"),
        F.min("bands").alias("bands"),
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")).alias("one"),
    )
    classes = materialize(classes, "classes")

    with passing(docs.sparkSession), unbroadcast(docs.sparkSession):
        roots = _grouped(docs, classes, size, percent, id_col, text_col)
    # these joins run when the caller reads them, under the session's thresholds: hints keep them off the driver
    named = classes.join(roots.hint("merge"), classes["class"] == roots["node"], "left").select("class", "copies", "one", F.coalesce("root", "class").alias("root"))
    smallest = named.groupBy("root").agg(F.min("one").alias("one"))
    return rows, named.drop("one").join(smallest.hint("merge"), "root").select("class", "copies", "one").hint("merge")


def _grouped(docs: DataFrame, classes: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Stored (node, root) of the classes that have links."""
    # the first half of the class is enough to find buckets of several; should two classes share it, both are looked at
    short = F.conv(F.hex(F.substring("class", 1, 7)), 16, 10).cast("long")
    spread = classes.select(short.alias("short"), F.explode("bands").alias("bucket"))
    several = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    found = spread.join(several, "bucket").join(classes.select("class", "rep", "n", short.alias("short")), "short").drop("short")
    found = materialize(found, "found")
    centre = F.min(F.struct("class", "n"))
    stars = materialize(found.groupBy("bucket").agg(centre.alias("c")).select("bucket", F.col("c.class").alias("centre"), F.col("c.n").alias("centre_n")), "stars")
    members = materialize(found.join(stars, "bucket"), "members")
    fits = F.expr(f"100 * least(n, centre_n) >= {percent} * greatest(n, centre_n)")
    candidates = members.where("class <> centre").where(fits).select(F.col("centre").alias("a"), F.col("class").alias("b")).distinct()
    sets = _sets(docs, members.select("class", "rep"), size, id_col, text_col)
    hashes = sets.select("class", "hashes")
    pairs = candidates.join(hashes.toDF("b", "b_hashes"), "b").join(hashes.toDF("a", "a_hashes"), "a").select("a", "b", "a_hashes", "b_hashes")
    links = materialize(_confirm(pairs, percent), "links")
    roots = connected_components(links)

    missed = materialize(_complete(members, roots, sets, percent), "missed")
    if not missed.isEmpty():
        roots = connected_components(links.unionByName(missed))
    return materialize(roots, "roots", keep=True)

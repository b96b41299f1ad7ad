"""Benchmark decontamination on a distributed positional inverted index.

``build_index`` cuts the corpus into blocks of documents and stores, per block,
the positions of every word: the usual document-partitioned index, so postings
are never shuffled and a block fits one task whatever the corpus size.
``search`` sends the test windows to the blocks.  In a block a window's posting
lists are shifted by the term's offset and intersected from the rarest term
on; most windows end at a term that the block lacks.  Exact phrase matches
give spans; proximity matches (some ``reach`` consecutive words of a document
that hold every term of the window, in any order) are found on the same lists.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII bytes.

Test texts travel as arrays of word numbers and one sorted list of distinct
words; a part is closed before these exceed ``PART_BYTES``, whatever the texts.

Defined results: a null or empty text has no words and no hits; an item
without words matches nothing; the windows of an item without an id hit words
but name no item; items shorter than the window match as a whole; repeated
item ids count once; repeated rows and equal doc_ids stay separate rows; empty
tables give empty or clean results; columns other than id and text are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, pack, raw_texts, unpack, without
from .exact_dedup import sha256

#: Lower-cases A-Z and blanks out what is not part of a word.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A block is closed at this many words.
BLOCK_WORDS = 1_000_000
#: Test texts are sent to the blocks in parts of at most this many bytes, counted as they are broadcast.
PART_BYTES = 32 << 20

INDEX_SCHEMA = "block long, doc_ids array<long>, digests array<binary>, starts binary, n_words binary, terms binary, offsets binary, positions binary"
HIT_SCHEMA = "block long, doc int, doc_id long, digest binary, n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>, near_item_ids array<string>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """The stored index: one row per block of documents, with their digests if one is given.

    Positions count words from the start of the block, with one empty position
    after each document so that no phrase runs from one into the next.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        serial = count(task << 24)
        ids, digests, codes, vocabulary, total = [], [], [], defaultdict(count().__next__), 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(c) for c in codes], np.int32)
            starts = np.concatenate([[0], np.cumsum(lengths.astype(np.int64) + 1)])
            code = np.concatenate(codes).astype(np.int64)
            place = np.arange(len(code)) + np.repeat(np.arange(len(lengths)), lengths)
            keys = (code << 32) | place
            keys.sort()
            place = keys & 0xFFFFFFFF
            sizes = np.bincount(code, minlength=len(vocabulary))
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            gaps = np.diff(place, prepend=0)
            first = offsets[:-1][sizes > 0]
            gaps[first] = place[first]
            cells = [
                next(serial),
                ids,
                digests,
                pack(starts),
                pack(lengths),
                zstandard.ZstdCompressor(level=1).compress(b" ".join(vocabulary)),
                pack(sizes.astype(np.uint32)),
                pack(gaps.astype(np.uint32)),
            ]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=INDEX_NAMES)

        for batch in batches:
            for doc_id, text, key in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist()):
                found = words(text)
                ids.append(doc_id)
                digests.append(key)
                codes.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
                total += len(found)
                if total >= BLOCK_WORDS:
                    yield close()
                    ids, digests, codes, vocabulary, total = [], [], [], defaultdict(count().__next__), 0
        if ids:
            yield close()

    known = F.lit(None).cast("binary") if digest is None else digest
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), known.alias("digest"))
    return materialize(map_batches(source, blocks, INDEX_SCHEMA), "postings")


INDEX_NAMES = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]


class Windows:
    """Test windows over the items' words in a row: window k is the words ``starts[k]`` to ``starts[k] + lengths[k]``."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        codes = [np.fromiter(map(numbers.__getitem__, words(text)), np.int32, -1) for _, text in items]
        found = np.array(list(numbers), object)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.terms = b"".join(found[order])
        self.ends = np.cumsum([0, *map(len, found[order])])
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.codes = rank[np.concatenate(codes)] if codes else np.zeros(0, np.int32)
        sizes = np.array([len(c) for c in codes], np.int64)
        self.size = size
        self.item_ids = [i for i, _ in items]
        self.cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @property
    def nbytes(self) -> int:
        return self.hashes.nbytes + len(self.terms) + self.ends.nbytes + self.codes.nbytes + self.cuts.nbytes + sum(len(i or "") for i in self.item_ids)

    def spread(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and item of every window."""
        sizes = np.diff(self.cuts)
        n = np.where(sizes > 0, np.maximum(1, sizes - self.size + 1), 0)
        owner = np.repeat(np.arange(len(sizes)), n)
        first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
        return np.arange(len(owner)) - first[owner] + self.cuts[:-1][owner], np.minimum(sizes[owner], self.size), owner


class Postings:
    """One block of the index, opened for the terms of a search."""

    def __init__(self, row: dict, w: Windows):
        vocabulary = zstandard.ZstdDecompressor().decompress(row["terms"]).split(b" ")
        sizes = unpack(row["offsets"], np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        gaps = unpack(row["positions"], np.uint32).astype(np.int64)
        self.lists: dict[int, np.ndarray] = {}
        self.sizes = np.zeros(len(w.hashes), np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
        low, high = np.searchsorted(w.hashes, hashes), np.searchsorted(w.hashes, hashes, side="right")
        for k in np.flatnonzero((low < high) & (sizes > 0)).tolist():
            for term in range(low[k], high[k]):
                if w.terms[w.ends[term] : w.ends[term + 1]] == vocabulary[k]:
                    self.lists[term] = np.cumsum(gaps[ends[k] - sizes[k] : ends[k]])
                    self.sizes[term] = sizes[k]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Start positions of the word sequence."""
        order = np.argsort(self.sizes[terms], kind="stable")
        starts = self.lists[int(terms[order[0]])] - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            places = self.lists[int(terms[k])]
            at = np.searchsorted(places, starts + k)
            starts = starts[places[np.minimum(at, len(places) - 1)] == starts + k]
        return starts

    def near(self, terms: np.ndarray, reach: int, doc_of, doc_starts: np.ndarray) -> np.ndarray:
        """Documents with ``reach`` consecutive words that hold all of the distinct ``terms``."""
        order = terms[np.argsort(self.sizes[terms], kind="stable")]
        places = self.lists[int(order[0])]
        # every other term stands less than ``reach`` words from the rarest one
        for term in order[1:].tolist():
            if not len(places):
                break
            other = self.lists[term]
            at = np.searchsorted(other, places - reach + 1)
            places = places[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] < places + reach)]
        if len(order) > 1 and len(places):
            places = places[self._together(order, places, reach, doc_of, doc_starts)]
        return np.unique(doc_of(places))

    def _together(self, order: np.ndarray, places: np.ndarray, reach: int, doc_of, doc_starts: np.ndarray) -> np.ndarray:
        """For positions of the first term, whether a span of ``reach`` words around it holds one position of every term."""
        doc = doc_of(places)
        # a span that holds all begins at one of the terms; each beginning is tried for all positions at once
        good = np.zeros(len(places), bool)
        for term in order.tolist():
            mine = self.lists[term]
            lo, hi = np.searchsorted(mine, np.maximum(places - reach + 1, doc_starts[doc])), np.searchsorted(mine, places, side="right")
            for step in range(int((hi - lo).max(initial=0))):
                some = np.flatnonzero((lo + step < hi) & ~good)
                begin = mine[(lo + step)[some]]
                end = np.minimum(begin + reach, doc_starts[doc[some] + 1])
                holds = np.ones(len(some), bool)
                for other in order.tolist():
                    where = self.lists[other]
                    holds &= np.searchsorted(where, end) > np.searchsorted(where, begin)
                good[some[holds]] = True
        return good


def search(index: DataFrame, items: DataFrame, window: int = 10, reach: int | None = None, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, digest (null unless indexed), n_words, spans of hit words [start, end), item_ids, near_item_ids.

    ``reach`` asks for proximity matches besides the exact ones.
    """
    spark = index.sparkSession
    source = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    found, n_parts = None, 0
    for w in _parts(source, window):
        hits = map_batches(index, _searcher(spark.sparkContext.broadcast(w), reach), HIT_SCHEMA)
        found, n_parts = hits if found is None else found.unionByName(hits), n_parts + 1
    if n_parts > 1:
        found = _merged(found)
    return found.drop("block", "doc")


def _parts(source: DataFrame, window: int) -> Iterator[Windows]:
    """All items, in parts that take ``PART_BYTES`` when broadcast; a single larger item is a part of its own."""
    held, size, made = [], 0, False
    for row in source.toLocalIterator():
        text = row["t"].encode()
        # at worst every word is new: its bytes, end, hash and number; a word takes two bytes of text at least
        cost = 11 * (len(text) + 1) + len(row["i"] or "") + 8
        if held and size + cost > PART_BYTES:
            w = Windows(held, window)
            if w.nbytes + cost > PART_BYTES:
                yield w
                made, held, size = True, [], 0
            else:
                size = w.nbytes
        held.append((row["i"], text))
        size += cost
    if held or not made:
        yield Windows(held, window)


def _searcher(windows, reach):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in INDEX_NAMES}
                yield _search_block(row, windows.value, reach)

    return run


def _search_block(row: dict, w: Windows, reach: int | None) -> pa.RecordBatch:
    starts, lengths = unpack(row["starts"], np.int64), unpack(row["n_words"], np.int32).astype(np.int64)
    postings = Postings(row, w)
    first, size, owner = w.spread()
    # windows with a term that the block lacks can't match
    lacking = np.concatenate([[0], np.cumsum(postings.sizes[w.codes] == 0)])
    alive = np.flatnonzero(lacking[first + size] == lacking[first])
    edge = np.zeros(starts[-1] + 1, np.int64)
    doc_of = lambda places: np.searchsorted(starts, places, side="right") - 1
    exact: dict[int, set[str]] = defaultdict(set)
    close: dict[int, set[str]] = defaultdict(set)
    for k in alive.tolist():
        terms, item = w.codes[first[k] : first[k] + size[k]], w.item_ids[owner[k]]
        at = postings.phrase(terms)
        if len(at):
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size[k], -1)
            for d in np.unique(doc_of(at)).tolist():
                exact[d].add(item)
        if reach is not None:
            for d in postings.near(np.unique(terms), reach, doc_of, starts).tolist():
                close[d].add(item)
    spans: dict[int, list[dict]] = defaultdict(list)
    if exact:
        on = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
        turn = np.diff(on)
        for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
            d = int(doc_of(a))
            spans[d].append({"start": int(a - starts[d]), "end": int(b - starts[d])})
    n = len(lengths)
    columns = [
        pa.array([row["block"]] * n, pa.int64()),
        pa.array(range(n), pa.int32()),
        pa.array(row["doc_ids"], pa.int64()),
        pa.array(row["digests"], pa.binary()),
        pa.array(lengths),
        pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        pa.array([sorted(exact.get(d, set()) - {None}) for d in range(n)], pa.list_(pa.string())),
        pa.array([sorted(close.get(d, set()) - {None}) for d in range(n)], pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["block", "doc", "doc_id", "digest", "n_words", "spans", "item_ids", "near_item_ids"])


def _merged(found: DataFrame) -> DataFrame:
    """Rows of several parts of the test set brought together: spans united, ids listed once."""
    gather = lambda c: F.flatten(F.collect_list(c))
    both = found.groupBy("block", "doc").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("digest").alias("digest"),
        F.first("n_words").alias("n_words"),
        F.array_sort(gather("spans")).alias("spans"),
        F.array_sort(F.array_distinct(gather("item_ids"))).alias("item_ids"),
        F.array_sort(F.array_distinct(gather("near_item_ids"))).alias("near_item_ids"),
    )
    united = F.expr(
        """aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (done, s) ->
             case when size(done) > 0 and s.start <= element_at(done, -1).end
                  then concat(slice(done, 1, size(done) - 1),
                              array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end))))
                  else concat(done, array(s)) end)"""
    )
    return both.withColumn("spans", united)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text has an exact match; equal texts are judged alike, ids play no part."""
    digest = sha256(F.coalesce(F.col(text_col), F.lit("")))
    found = search(build_index(docs, id_col, text_col, digest), items, window)
    gone = materialize(found.where(F.size("spans") > 0).select("digest").distinct(), "contaminated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), digest.alias("digest"))
    return without(rows, gone, ["digest"]).select("record.*")


def n_hit(spans="spans"):
    """Number of words inside the spans."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])

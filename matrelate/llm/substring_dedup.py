"""Removal of repeated passages by seed and extend.

Seeds are winnowed anchors: of every window of ``length`` words, the smallest
hash of its word ``GRAM``-grams, the rightmost on ties.  Equal windows choose
the same anchor at the same place, so every repeat of at least ``length``
words has a common anchor.

1. Anchors are joined over all documents.  Those that occur once are dropped.
2. Around each joined anchor every window that can hold it is matched by its
   hash with the nearest other occurrence: the one in the block before.
3. Matches that continue each other on one diagonal are extended, to both
   sides, to one maximal match of a stretch of words with its partner.
4. The words of every maximal match travel to the partner's block and are
   compared there, word by word; repeats inside a block are compared in place.
   Windows whose hash two different word sequences share (2^-64 a pair) are
   counted again by their words.
5. Overlapping repeated windows unite to maximal repeats, which are removed.

Occurrences are never paired with each other: a block sends a distinct window
once, and each has one partner, the next block before it.  So the matches of a
passage that a third of all documents share are a chain over the blocks, of
one link a block, and no block is asked more than it holds itself.

Defined results: null and empty texts have no words; documents shorter than
the window keep everything; a repeat within one document counts; repeated rows
repeat each other's passages, so all copies lose them; null ids and equal ids
are separate rows; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, answered, ask, build_blocks, open_block, rows_of, shard_bounds, shard_count, with_answers
from .common import bundle, map_batches, materialize, mix64, pack, passing, unbundle, unpack

#: Words of an anchor.
GRAM = 10
#: Bits of a hash that decide among anchors; the others hold the position.
POSITION_BITS = 30
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Colliding hashes that the driver takes at once (8 bytes each).
PASS_HASHES = 1_000_000
#: Windows that are compared word by word at once.
RUN = 1 << 15

SENT = "block long, shard int, keys binary, many binary, places binary"
#: What a block finds: itself with the starts of its repeated windows (kind 0), or stretches to be compared in the block of the row (kind 1), or the hash of different windows (kind 2).
FOUND = "block long, kind int, starts binary, sizes binary, said binary, hash long, doc_ids array<long>, lengths binary, codes binary, vocabulary binary"
FOUND_NAMES = [f.split()[0] for f in FOUND.split(", ")]
#: The columns of a block that is passed on.
OWN = ["doc_ids", "lengths", "codes", "vocabulary"]
OUT_SCHEMA = "doc_id long, n_words long, repeats array<struct<start:int,end:int>>, kept string"


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    size, step = 1, base
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(step)
        size += more
        step = step * step % (1 << 64)
    return out[:n]


class Sequences:
    """Hashes of word sequences at every position of a block."""

    def __init__(self, block: Block):
        self.n = len(block.codes)
        with np.errstate(over="ignore"):
            words = mix64(block.word_hashes())[block.codes] if self.n else np.zeros(0, np.uint64)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, self.n))])
        self.unscale = _powers(_INVERSE, self.n)

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[starts + size] - self.sums[starts]) * self.unscale[starts])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def windows(block: Block, length: int) -> tuple[Sequences, np.ndarray, np.ndarray]:
    """Start of every window inside one document, and the position of its anchor."""
    seq = Sequences(block)
    if seq.n < length:
        return seq, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = min(GRAM, length)
    hashes = seq.at(np.arange(seq.n - gram + 1), gram)
    low = np.uint64((1 << POSITION_BITS) - 1)
    order = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    anchor = (low - (_sliding_min(order, length - gram + 1) & low)).astype(np.int64)
    room = np.maximum(block.lengths - length + 1, 0)
    first = np.repeat(block.cuts[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room)
    starts = np.arange(len(first)) + first
    return seq, starts, anchor[starts]


def _send(number: int, keys: np.ndarray, many: np.ndarray, places: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Sorted distinct keys, whether each occurs more than once in the block, and where first, cut by shard."""
    bounds = shard_bounds(keys, shards)
    some = np.flatnonzero(np.diff(bounds))
    spans = [slice(bounds[s], bounds[s + 1]) for s in some]
    cells = [
        pa.array([number] * len(some), pa.int64()),
        pa.array(some, pa.int32()),
        pa.array([pack(np.diff(keys[x], prepend=np.uint64(0))) for x in spans], pa.binary()),
        pa.array([np.packbits(many[x]).tobytes() for x in spans], pa.binary()),
        pa.array([pack(places[x].astype(np.uint32)) for x in spans], pa.binary()),
    ]
    yield pa.RecordBatch.from_arrays(cells, names=["block", "shard", "keys", "many", "places"])


class _Group:
    """The keys that blocks sent to a shard, brought together; equal keys in the order of their blocks."""

    def __init__(self, rows: list[dict]):
        keys = [np.cumsum(unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        self.many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(k)) for r, k in zip(rows, keys)]).astype(bool)
        every = np.concatenate(keys)
        self.cuts = np.cumsum([0, *map(len, keys)])
        self.order = np.argsort(every, kind="stable")
        ordered = every[self.order]
        self.first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        last = np.append(self.first[1:], True)
        alone = np.empty(len(every), bool)
        alone[self.order] = self.first & last
        #: whether a key occurs more than once in the corpus
        self.repeated = ~alone | self.many

    def split(self, values: np.ndarray) -> list[np.ndarray]:
        return [values[a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:])]


def _joined(shard: int, rows: list[dict]) -> list[bytes]:
    """For every anchor sent to a shard, whether it occurs more than once in the corpus."""
    g = _Group(rows)
    return [pack(x) for x in g.split(g.repeated.astype(np.uint8))]


def _partners(shard: int, rows: list[dict]) -> list[bytes]:
    """For every window: 0 if it occurs once, 2 if a block before holds it, else 1; and that block and the place there."""
    g = _Group(rows)
    places = np.concatenate([unpack(r["places"], np.uint32) for r in rows])
    owner = np.repeat(np.array([r["block"] for r in rows], np.int64), np.diff(g.cuts))
    later = np.flatnonzero(~g.first)
    at, before = g.order[later], g.order[later - 1]
    kind = g.repeated.astype(np.uint8)
    kind[at] = 2
    block, place = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.uint32)
    block[at], place[at] = owner[before], places[before]
    out = []
    for k, b, p in zip(*map(g.split, (kind, block, place))):
        out.append(bundle(k, b[k == 2], p[k == 2]))
    return out


class _Seeded:
    """Windows of a block whose anchor occurs elsewhere: starts, hashes, and the distinct hashes among them."""

    def __init__(self, row: dict, length: int, bits: int):
        self.block = open_block(row)
        seq, starts, anchors = windows(self.block, length)
        _, place = np.unique(seq.at(anchors, min(GRAM, length)), return_inverse=True)
        shared = answered(row, "anchors", np.uint8)
        self.starts = starts[shared[place] > 0] if len(place) else starts
        hashes = seq.at(self.starts, length) >> np.uint64(64 - bits)
        self.keys, first, self.place, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        self.first, self.many = self.starts[first], n > 1


def _stretches(starts: np.ndarray, blocks: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matched windows in order of their starts, run together where start and partner's place both go on by one: first window and number of each."""
    on = (np.diff(starts) == 1) & (np.diff(blocks) == 0) & (np.diff(places) == 1)
    first = np.flatnonzero(np.concatenate([[True], ~on])) if len(starts) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(starts)))


def _row(block: int, kind: int, **cells) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3]
    values = {"block": block, "kind": kind} | cells
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], t) for n, t in zip(FOUND_NAMES, types)], names=FOUND_NAMES)


def _differing(block: Block, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows that start at ``a`` have other words than those at ``b``."""
    span, out = np.arange(length), np.zeros(len(a), bool)
    for at in range(0, len(a), RUN):
        x, y = a[at : at + RUN, None] + span, b[at : at + RUN, None] + span
        out[at : at + RUN] = (block.codes[x] != block.codes[y]).any(axis=1)
    return out


def _decide(row: dict, length: int, bits: int, doubtful: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's repeated windows without those of doubtful hashes, and what is to be compared elsewhere."""
    s = _Seeded(row, length, bits)
    parts = [unbundle(a["answer"], np.uint8, np.int64, np.uint32) for a in row["matches"] or []]
    kind, partner, place = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
    good = ~np.isin(s.keys, doubtful)
    repeated = (kind > 0) & good
    yield _row(s.block.number, 0, starts=pack(np.diff(s.starts[repeated[s.place]], prepend=0)), **{c: row[c] for c in OWN})
    # inside the block, with the first of equal windows
    again = np.flatnonzero((s.many & good)[s.place])
    bad = again[_differing(s.block, s.starts[again], s.first[s.place[again]], length)]
    for h in np.unique(s.keys[s.place[bad]]).view(np.int64).tolist():
        yield _row(s.block.number, 2, hash=h)
    # in the partner's block
    matched = np.flatnonzero(kind == 2)
    use = good[matched]
    matched, partner, place = matched[use], partner[use], place[use].astype(np.int64)
    order = np.argsort(s.first[matched])
    starts, partner, place = s.first[matched][order], partner[order], place[order]
    first, n = _stretches(starts, partner, place)
    words = s.block.vocabulary
    for other in np.unique(partner[first]).tolist():
        mine = first[partner[first] == other]
        sizes = n[partner[first] == other] + length - 1
        said = [b" ".join(map(words.__getitem__, s.block.codes[a : a + k].tolist())) for a, k in zip(starts[mine].tolist(), sizes.tolist())]
        yield _row(other, 1, starts=pack(place[mine]), sizes=pack(sizes), said=zstandard.ZstdCompressor(level=1).compress(b"\n".join(said)))


def _compare(rows: Iterator[dict], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks, each followed by the stretches that others have matched with it: hashes of windows that differ."""
    block = held = None
    for row in rows:
        if row["kind"] == 0:
            held, block = row, None
            continue
        block = block or open_block(held)
        said = zstandard.ZstdDecompressor().decompress(row["said"]).split(b"\n")
        words, codes = block.vocabulary, block.codes
        for start, size, text in zip(unpack(row["starts"], np.int64).tolist(), unpack(row["sizes"], np.int64).tolist(), said):
            if b" ".join(map(words.__getitem__, codes[start : start + size].tolist())) == text:
                continue
            theirs = text.split(b" ")
            wrong = [words[c] != w for c, w in zip(codes[start : start + size].tolist(), theirs)]
            hashes = Sequences(block).at(np.arange(start, start + size - length + 1), length) >> np.uint64(64 - bits)
            for k, h in enumerate(hashes.view(np.int64).tolist()):
                if any(wrong[k : k + length]):
                    yield _row(block.number, 2, hash=h)


def find_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Per document: doc_id, n_words, maximal repeats [start, end) in words, and the text that is kept.

    ``bits`` shortens the windows' hashes, which costs time but changes no result.
    """
    spark = docs.sparkSession
    blocks = build_blocks(docs, lower=False, id_col=id_col, text_col=text_col)
    with passing(spark):
        decided = _find(blocks, length, bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            found = [np.cumsum(unpack(row[c], np.int64)) for c in ("starts", "more") if row.get(c)]
            yield _without(open_block(row), np.concatenate(found), length)

    return map_batches(decided, cut, OUT_SCHEMA)


def _find(blocks: DataFrame, length: int, bits: int) -> DataFrame:
    """Stored blocks with the starts of their repeated windows (starts, and more where hashes collide)."""
    shards = shard_count(blocks, 0.15)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = open_block(row)
            seq, _, anchors = windows(block, length)
            # an anchor's occurrences are its positions; windows choose one several times
            places = np.unique(anchors)
            keys, first, n = np.unique(seq.at(places, min(GRAM, length)), return_index=True, return_counts=True)
            yield from _send(block.number, keys, n > 1, np.zeros(len(keys)), shards)

    anchors = ask(map_batches(blocks, seeds, SENT), _joined, "anchors")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            s = _Seeded(row, length, bits)
            yield from _send(s.block.number, s.keys << np.uint64(64 - bits), s.many, s.first, shards)

    seeded = with_answers(blocks, anchors=anchors)
    matches = ask(map_batches(seeded, extend, SENT), _partners, "windows")
    matched = with_answers(seeded, matches=matches)

    def decide(doubtful: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                yield from _decide(row, length, bits, doubtful)

        return run

    found = materialize(map_batches(matched, decide(np.zeros(0, np.uint64)), FOUND), "found", keep=True)
    own = found.where("kind = 0").select("block", "starts", *OWN)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _compare(rows_of(batches), length, bits)

    # of a block only what a comparison reads moves to the stretches; blocks that are not asked have none
    both = found.where("kind < 2").withColumns({c: F.when(F.col("kind") == 1, F.col(c)) for c in ("starts", "sizes")}).drop("hash", "doc_ids")
    both = both.repartition("block").sortWithinPartitions("block", "kind")
    hashes = found.where("kind = 2").select("hash").unionByName(map_batches(both, compare, FOUND).select("hash"))
    hashes = materialize(hashes.distinct(), "doubtful")
    n = hashes.count()
    if not n:
        return own
    parts = -(-n // PASS_HASHES)
    collected = [np.array([r["hash"] for r in hashes.where(F.pmod("hash", F.lit(parts)) == k).collect()], np.int64).view(np.uint64) for k in range(parts)]
    sure = map_batches(matched, decide(np.concatenate(collected)), FOUND).where("kind = 0").select("block", "starts", *OWN)
    more = _by_words(seeded, np.concatenate(collected), length, bits)
    return materialize(sure.join(more, "block", "left"), "decided", keep=True)


def _by_words(seeded: DataFrame, doubtful: np.ndarray, length: int, bits: int) -> DataFrame:
    """Starts of repeated windows among those of the given hashes, told apart by their words."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            s = _Seeded(row, length, bits)
            words, codes = s.block.vocabulary, s.block.codes
            starts = s.starts[np.isin(s.keys, doubtful)[s.place]]
            for at in range(0, len(starts), 1024):
                part = starts[at : at + 1024].tolist()
                said = [b" ".join(map(words.__getitem__, codes[a : a + length].tolist())) for a in part]
                yield pa.RecordBatch.from_arrays([pa.array([s.block.number] * len(part)), pa.array(part), pa.array(said, pa.binary())], names=["block", "start", "said"])

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        starts = np.sort(table["start"].to_numpy())
        return pa.table({"block": [key[0].as_py()], "more": [pack(np.diff(starts, prepend=0))]})

    spelt = map_batches(seeded, spell, "block long, start long, said binary")
    several = spelt.groupBy("said").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("said")
    return spelt.join(several, "said", "left_semi").groupBy("block").applyInArrow(gather, "block long, more binary")


def _without(block: Block, starts: np.ndarray, length: int) -> pa.RecordBatch:
    n, cuts = len(block.codes), block.cuts
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + length] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    words, kept, repeats = block.vocabulary, [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        gone = covered[a:b]
        turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        repeats.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2])])
        kept.append(b" ".join(map(words.__getitem__, block.codes[a:b][~gone].tolist())).decode(errors="replace"))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block.doc_ids, pa.int64()),
            pa.array(block.lengths, pa.int64()),
            pa.array(repeats, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array(kept, pa.string()),
        ],
        names=["doc_id", "n_words", "repeats", "kept"],
    )

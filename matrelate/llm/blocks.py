"""Documents packed into blocks, and questions that blocks ask of the whole corpus.

A block holds some documents as numbers: every word is replaced by its place
in the block's own vocabulary.  Blocks are stored once; later passes read them
without tokenising again.

``ask`` is the one exchange that the operators need.  Each block sends sorted
distinct 64-bit keys, cut by key range into shards; a shard sees a key once
per block at most, whatever the key's frequency, and answers for all blocks
that sent it.  Answers return to their block in the order of its keys.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_batches, materialize, pack, raw_texts, shuffle_partitions, unpack

#: A block is closed at this many words; one document is never cut.
BLOCK_WORDS = 1_200_000
#: Shards are as many as keep a shard's keys around this number.
SHARD_KEYS = 1_000_000

BLOCK_SCHEMA = "block long, words long, doc_ids array<long>, lengths binary, codes binary, vocabulary binary"
BLOCK_NAMES = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]


@dataclass
class Block:
    """One block, opened: ``codes`` are all words in a row, ``cuts`` where documents begin and end."""

    number: int
    doc_ids: list
    lengths: np.ndarray
    codes: np.ndarray
    vocabulary: list[bytes]

    @property
    def cuts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.lengths)])

    def word_hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary))


def open_block(row: dict) -> Block:
    words = zstandard.ZstdDecompressor().decompress(row["vocabulary"])
    return Block(row["block"], row.get("doc_ids"), unpack(row["lengths"], np.int32).astype(np.int64), unpack(row["codes"], np.int32), words.split(b" ") if words else [])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time; a row may be megabytes."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def build_blocks(docs: DataFrame, lower: bool, id_col: str = "doc_id", text_col: str = "text", share: float = 1.0) -> DataFrame:
    """Stored blocks of all documents; words are runs of anything but ASCII white space.  ``share`` makes blocks smaller."""
    most = int(BLOCK_WORDS * share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = count(TaskContext.get().partitionId() << 24)
        ids, codes, vocabulary, total = [], [], defaultdict(count().__next__), 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(c) for c in codes], np.int32)
            cells = [
                next(serial),
                total,
                ids,
                pack(lengths),
                pack(np.concatenate(codes)),
                zstandard.ZstdCompressor(level=1).compress(b" ".join(vocabulary)),
            ]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=BLOCK_NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                found = (text.translate(LOWER) if lower else text).split() if text else []
                ids.append(doc_id)
                codes.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
                total += len(found)
                if total >= most:
                    yield close()
                    ids, codes, vocabulary, total = [], [], defaultdict(count().__next__), 0
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(map_batches(rows, run, BLOCK_SCHEMA), "blocks")


def shard_count(blocks: DataFrame, keys_per_word: float) -> int:
    words = blocks.agg(F.sum("words")).first()[0] or 0
    return max(shuffle_partitions(blocks.sparkSession), int(words * keys_per_word / SHARD_KEYS) + 1)


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin in sorted uint64 keys: shards are equal ranges of the keys' upper half."""
    lows = ((np.arange(shards, dtype=np.uint64) << np.uint64(32)) + np.uint64(shards - 1)) // np.uint64(shards) << np.uint64(32)
    return np.append(np.searchsorted(keys, lows), len(keys))


def ask(
    sent: DataFrame,
    answer: Callable[[int, list[dict]], list[bytes]],
    name: str,
) -> DataFrame:
    """Answers to ``sent`` (block, shard and payload columns), stored as (block, shard, answer).

    ``answer`` gets a shard's rows and returns one answer for each; answers
    beyond these are stored under block -1.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        rows = table.to_pylist()
        rows.sort(key=lambda r: r["block"])
        got = answer(shard, rows)
        blocks = [r["block"] for r in rows] + [-1] * (len(got) - len(rows))
        return pa.table({"block": blocks, "shard": pa.array([shard] * len(got), pa.int32()), "answer": got})

    return materialize(sent.groupBy("shard").applyInArrow(run, "block long, shard int, answer binary"), name)


def with_answers(blocks: DataFrame, **answers: DataFrame) -> DataFrame:
    """Blocks with each set of answers as an array of (shard, answer) in shard order."""
    for name, df in answers.items():
        own = df.where("block >= 0").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "answer"))).alias(name))
        blocks = blocks.join(own, "block", "left")
    return blocks


def answered(row: dict, name: str, dtype) -> np.ndarray:
    """A block's answers end to end."""
    parts = [unpack(a["answer"], dtype) for a in row[name] or []]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)

"""Chat formatting at token level.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Role and text are encoded as
segments of their own and reserved ids, which no text can produce, are spliced
in between.  The loss mask comes from prefix sums over segment lengths: +1
where an assistant text begins, -1 where it ends.  Control strings inside
texts are escaped reversibly, so the rendered text can be parsed back too.

Turns are range-partitioned by (conversation, turn, role, text), so that a conversation
with a large share of all rows spreads over tasks.  Each task emits pieces:
whole turns of one conversation, cut at ``PIECE_TOKENS``, numbered in order.

Defined results: a null text or role is empty; rows with null conversation
form one conversation; null turns come first; equal turns are ordered by role,
then text; repeated rows are turns of their own; extra columns are ignored; an
empty table gives no pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import caches, map_batches, materialize, raw_texts, shuffle_partitions

START, END = "<|im_start|>", "<|im_end|>"
#: A piece is closed at this many tokens, always after a whole turn.
PIECE_TOKENS = 1 << 16
#: Turns alike up to this many characters of text stay in one range; the driver draws the ranges from samples of these.
BOUND_CHARS = 256
#: Conversations of several pieces that are broadcast as a filter; beyond it they are found by a shuffle.
BROADCAST_SPLIT = 500_000

PIECE_SCHEMA = "conv_id long, piece long, n_turns int, token_ids array<int>, loss_mask array<byte>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_ESCAPED = re.compile(r"\\([\\n])")


def escape(text: str) -> str:
    """Breaks up every ``<|`` with a backslash; one more where backslashes stand there already."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles end at a line end, so theirs are written as ``\\n``."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


class ChatTokenizer:
    """A byte-level BPE with two reserved ids after its own."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.coder = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.start = max(table.values()) + 1
        self.end = self.start + 1
        self.line = self.encode("\n")

    def encode(self, text: str) -> list[int]:
        return self.coder.encode_ordinary(text)

    def decode(self, ids: np.ndarray) -> str:
        return self.coder.decode_bytes(ids.tolist()).decode(errors="replace")

    def segments(self, role: str, text: str, trained: bool) -> list[tuple[list[int], bool]]:
        """One turn as (ids, under the loss mask)."""
        return [
            ([self.start], False),
            (self.encode(escape_role(role)), False),
            (self.line, False),
            (self.encode(escape(text)), trained),
            ([self.end], False),
            (self.line, False),
        ]

    def turns(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str, int]]:
        """Role, text, text under the mask and rendered length of each turn of a piece, read back from its tokens."""
        starts, ends = np.flatnonzero(ids == self.start), np.flatnonzero(ids == self.end)
        after = len(self.line)
        edges = np.flatnonzero(np.diff(mask, prepend=np.int8(0)))
        for a, b in zip(starts, ends):
            # every token is decoded once: a turn is cut where the mask changes
            cuts = [a + 1, *edges[np.searchsorted(edges, a + 2) : np.searchsorted(edges, b)], b]
            parts = [self.decode(ids[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
            body, tail = "".join(parts), self.decode(ids[b + 1 : b + 1 + after])
            trained = "".join(p for p, x, y in zip(parts, cuts[:-1], cuts[1:]) if x < y and mask[x])
            role, _, text = body.partition("\n")
            yield unescape_role(role), unescape(text), unescape(trained), len(START) + len(body) + len(END) + len(tail)


_tokenizers: dict[int, ChatTokenizer] = {}
caches[__name__] = _tokenizers.clear


def _tokenizer(spec) -> ChatTokenizer:
    key = hash(spec.value)
    if key not in _tokenizers:
        _tokenizers[key] = ChatTokenizer(*spec.value)
    return _tokenizers[key]


def tokenizer_spec(spark, ranks_path: str, pattern: str):
    """The vocabulary, read by the driver and sent to the workers (under a megabyte)."""
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def format_conversations(turns: DataFrame, spec, trained_role: str = "assistant", stored: bool = True) -> DataFrame:
    """Pieces of formatted conversations: conv_id, piece, n_turns, token_ids, loss_mask.

    ``piece`` orders the pieces of a conversation.
    """
    spark = turns.sparkSession
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    # a text's beginning runs in the order of the texts, so that ties cut by a range's bound stay in order
    spread = ["conv_id", "turn", "role", F.substring("text", 1, BOUND_CHARS)]
    rows = rows.repartitionByRange(shuffle_partitions(spark), *spread).sortWithinPartitions(*order)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec)
        serial = TaskContext.get().partitionId() << 32
        conv, parts, n_turns, size = None, [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal serial
            lengths = np.array([len(ids) for ids, _ in parts])
            ends = np.cumsum(lengths)
            edge = np.zeros(ends[-1] + 1, np.int8)
            trained = np.array([t for _, t in parts]) & (lengths > 0)
            np.add.at(edge, (ends - lengths)[trained], 1)
            np.add.at(edge, ends[trained], -1)
            ids = np.concatenate([np.asarray(i, np.int32) for i, _ in parts])
            mask = np.cumsum(edge[:-1], dtype=np.int8)
            serial += 1
            cells = [[conv], [serial], [n_turns], [ids], [mask]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cells, [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int8())])],
                names=["conv_id", "piece", "n_turns", "token_ids", "loss_mask"],
            )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            columns = (batch.column(0).to_pylist(), raw_texts(batch.column(2)), raw_texts(batch.column(3)))
            for c, role, text in zip(*columns):
                if parts and (c != conv or size >= PIECE_TOKENS):
                    held.append(close())
                    parts, n_turns, size = [], 0, 0
                conv, role = c, role.decode(errors="replace")
                new = tokenizer.segments(role, text.decode(errors="replace"), role == trained_role)
                parts += new
                n_turns += 1
                size += sum(len(ids) for ids, _ in new)
                if len(held) >= 256:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held = []
        if parts:
            held.append(close())
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    pieces = map_batches(rows, assemble, PIECE_SCHEMA)
    return materialize(pieces, "chat-pieces") if stored else pieces


def digest_conversations(pieces: DataFrame, spec) -> DataFrame:
    """Per conversation what its tokens say when read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest runs through a conversation in order, so the pieces of one that
    spans several are brought together and streamed; all others are digested
    where they are.
    """
    several = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("several_id"))
    few = several.limit(BROADCAST_SPLIT + 1).count() <= BROADCAST_SPLIT
    marked = F.col("conv_id").eqNullSafe(F.col("several_id"))
    side = F.broadcast(several) if few else several

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec)
        at, state, done = None, None, []

        def finish():
            n, turns, chars, loss, size = state
            done.append((at[0], n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done))
            done.clear()
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=DIGEST_NAMES)

        for batch in batches:
            convs = batch.column(0).to_pylist()
            for k, conv in enumerate(convs):
                if at is None or at[0] != conv:
                    if at is not None:
                        finish()
                    at, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = (batch.column(i)[k].values.to_numpy() for i in (1, 2))
                for role, text, trained, size in tokenizer.turns(ids, mask):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                    state[4] += size
            if done:
                yield flush()
        if at is not None:
            finish()
        if done:
            yield flush()

    columns = ["conv_id", "token_ids", "loss_mask"]
    whole = map_batches(pieces.join(side, marked, "left_anti").select(*columns), read, DIGEST_SCHEMA)
    spread = pieces.join(side, marked, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "piece").select(*columns)
    return whole.unionByName(map_batches(spread, read, DIGEST_SCHEMA))


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_NAMES = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")]

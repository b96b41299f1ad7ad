"""SentencePiece BPE encoding and decoding with a prefix table.

The encoding of a text is recovered from one table: for each prefix, the last
token of that prefix's encoding.  That token is unique, and it is the match
ending at the prefix's end which is compatible with the last token of the
prefix before it; two tokens are compatible when merging their joined strings
would give back just these two.  Matches come from an automaton over all
pieces, compatibility from the tokens' merge trees, and the ids are read off
backwards.

Pieces never run from a letter into the space mark, and characters outside the
vocabulary fall back to bytes, so a text falls apart into short independent
segments whose encodings are cached; a text of any length is encoded whole.
Pieces made of space marks alone share one score, where the merge further left
comes first; the compatibility test knows that rule, so runs of spaces go
through the table like everything else.

Decoding reads the ids: their surfaces are taken from a table, end to end, and
the mark put in front of the text is taken off.

Defined results: a null or empty text has no ids and decodes to the empty
text; repeated rows, null ids and other columns pass through untouched.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import caches, map_batches, raw_texts

SPACE = "▁"
#: Segments remembered by a worker; later ones are computed again for each batch.
CACHE_SEGMENTS = 300_000
#: Token pairs remembered by a worker.
PAIRS = 400_000
#: Texts are encoded in groups of about this many bytes.
GROUP_BYTES = 2 << 20
#: Ids of a group that are written as decimals by Arrow at most.
LONG_IDS = 1 << 28


def load_model(path: str) -> dict:
    """The parts of a model file that encoding needs; rejects models this codec does not cover."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
        raise ValueError("only BPE models with byte fallback and without normalisation are covered")
    if not (norm.add_dummy_prefix and norm.escape_whitespaces) or train.treat_whitespace_as_suffix:
        raise ValueError("the model must mark spaces and add one in front")
    normal, byte = {}, {}
    for k, p in enumerate(model.pieces):
        if p.type == 1:
            normal[p.piece] = (k, p.score)
        elif p.type == 6:
            byte[int(p.piece[3:5], 16)] = k
        elif p.type not in (2, 3):
            raise ValueError(f"piece type {p.type} is not covered")
    return {"normal": normal, "byte": byte}


class _Pairs(dict):
    """Compatibility of token pairs, worked out when first asked for."""

    def __init__(self, compatible):
        self.compatible = compatible

    def __missing__(self, key: int) -> bool:
        fits = self[key] = self.compatible(key >> 20, key & 0xFFFFF)
        return fits


class PieceCodec:
    """Encoder and decoder of one model."""

    def __init__(self, model: dict):
        normal, self.byte = model["normal"], model["byte"]
        self.score = {s: v for s, (_, v) in normal.items()}
        self.id_of = {s: k for s, (k, _) in normal.items()}
        self.surface = {k: s for s, k in self.id_of.items()}
        marked = [s for s in normal if SPACE in s]
        if any(s.strip(SPACE) and SPACE in s[1:] for s in marked):
            raise ValueError("a piece runs from text into a space")
        joined = [v for s, (_, v) in normal.items() if len(s) > 1 and s.strip(SPACE)]
        if len(set(joined)) < len(joined):
            raise ValueError("pieces of text must have distinct scores")
        self.breaks = "[\n" + SPACE + "][^\n" + SPACE + "]*" if not any("\n" in s for s in normal) else SPACE + "[^" + SPACE + "]*"
        self.segments = re.compile(self.breaks)
        known = {c for s in normal for c in s if c in normal}
        self.known = known
        self._build_trees()
        self.pairs = _Pairs(self.compatible)
        self.cache: dict[str, bytes] = {}
        bytes_of = {k: s.replace(SPACE, " ").encode() for s, k in self.id_of.items()} | {k: bytes([b]) for b, k in self.byte.items()}
        size = max(bytes_of, default=-1) + 1
        # ids that stand for nothing (control and unknown pieces) decode to nothing
        self.bytes_of = pa.array([bytes_of.get(k, b"") for k in range(size)], pa.large_binary())
        self.written = pa.array([str(k) for k in range(size)], pa.string())

    # -- merge trees -----------------------------------------------------

    def merge(self, symbols: list[str]) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """Merging taken literally: best score first, leftmost on ties; also how each result was put together."""
        symbols, made, queue = list(symbols), {}, []
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(symbols):
                both = symbols[a] + symbols[b]
                if both in self.score:
                    heapq.heappush(queue, (-self.score[both], a, b, both))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        while queue:
            _, a, b, both = heapq.heappop(queue)
            if not symbols[a] or not symbols[b] or symbols[a] + symbols[b] != both or after[a] != b:
                continue
            made[both] = (symbols[a], symbols[b])
            symbols[a], symbols[b] = both, ""
            after[a] = after[b]
            if after[b] < len(symbols):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s], made

    def _build_trees(self) -> None:
        """For each piece that merging can produce: its right spine and left spine, each part with the score that consumes it."""
        self.left: dict[int, list[tuple[str, float]]] = {}
        self.right: dict[int, list[tuple[str, float]]] = {}
        self.automaton = ahocorasick.Automaton()
        parts: dict[str, tuple[str, str]] = {}
        for s in sorted(self.id_of, key=len):
            if any(c not in self.known for c in s):
                continue
            if len(s) > 1:
                whole, made = self.merge(list(s))
                if whole != [s]:
                    continue  # can't be reached by merging
                parts[s] = made[s]
                # a run of marks may equal its parts, as the merge further left comes first there
                if any(len(x) > 1 and (self.score[x] < self.score[s] or self.score[x] == self.score[s] and s.strip(SPACE)) for x in made[s]):
                    raise ValueError("a piece scores above one of its parts")
            k = self.id_of[s]
            for side, spines in ((0, self.left), (1, self.right)):
                spine, part, consumed = [], s, -float("inf")
                while True:
                    spine.append((part, consumed))
                    if len(part) == 1:
                        break
                    consumed, part = self.score[part], parts[part][side]
                spines[k] = spine
            self.automaton.add_word(s, (len(s), k))
        self.automaton.make_automaton()

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the two joined strings gives exactly these two tokens.

        Walks both spines at the seam in the order in which merging builds
        them.  A part of the left token and a part of the right one that stand
        there at the same time would merge if their union scores above what
        consumes either of them; on equal scores the merge further left comes
        first.
        """
        left, right = self.right[a], self.left[b]
        i, j, score = len(left) - 1, len(right) - 1, self.score
        while True:
            (x, x_consumed), (y, y_consumed) = left[i], right[j]
            union = score.get(x + y)
            if union is not None and union > x_consumed and union >= y_consumed:
                return False
            if x_consumed >= y_consumed:
                if not i:
                    return True  # both are whole
                i -= 1
            else:
                j -= 1

    # -- encoding --------------------------------------------------------

    def prefix_table(self, text: str) -> list[int]:
        """The last token of each prefix's encoding; 0 at segment starts and at characters outside the vocabulary."""
        # entry k is for the prefix that ends with character k; the one at -1 is the empty prefix
        last = [0] * (len(text) + 1)
        fits = self.pairs
        if len(fits) > PAIRS:
            fits.clear()
        for end, (size, token) in self.automaton.iter(text):
            if not last[end]:
                before = last[end - size]
                if not before or fits[before << 20 | token]:
                    last[end] = token
        return last

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of independent segments, each starting with a space mark or a line end."""
        # a line end matches no piece, so it parts the segments in the joined text
        text = "\n".join(segments)
        last, out, at = self.prefix_table(text), [], 0
        for s in segments:
            ids, end = [], at + len(s)
            while end > at:
                token = last[end - 1]
                if token:
                    ids.append(token)
                    end -= len(self.surface[token])
                else:
                    ids.extend(self.byte[b] for b in reversed(text[end - 1].encode()))
                    end -= 1
            ids.reverse()
            out.append(ids)
            at += len(s) + 1
        return out

    def split(self, text: str) -> list[str]:
        """Segments of a text; a run of several space marks stays with what follows it."""
        marked = SPACE + text.replace(" ", SPACE)
        found = self.segments.findall(marked)
        if SPACE + SPACE not in marked:
            return found
        out, run = [], 0
        for k, s in enumerate(found):
            if s == SPACE and k + 1 < len(found) and found[k + 1][0] == SPACE:
                run += 1
            else:
                out.append(SPACE * run + s)
                run = 0
        return out

    def learn(self, segments: set[str]) -> list[str]:
        """Encode those of ``segments`` that are not cached; returns them."""
        new = list(segments.difference(self.cache))
        for s, ids in zip(new, self.encode_segments(new)):
            self.cache[s] = array("i", ids).tobytes()
        return new

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and end."""
        split = [self.split(t) if t else [] for t in texts]
        new = self.learn(set().union(*split))
        ids = self.cache.__getitem__
        joined = [b"".join(map(ids, s)) for s in split]
        if len(self.cache) > CACHE_SEGMENTS:
            for s in new:
                del self.cache[s]
        return np.frombuffer(b"".join(joined), np.int32), np.cumsum([0, *map(len, joined)]) // 4

    def encode(self, text: str) -> list[int]:
        return self.run([text])[0].tolist()

    # -- decoding --------------------------------------------------------

    def decode_all(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The text of each run of ids ``cuts[k]`` to ``cuts[k + 1]``: surfaces end to end, without the mark in front."""
        taken = self.bytes_of.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1)[cuts] if len(ids) else np.zeros(len(cuts), np.int64)
        data = taken.buffers()[2].to_pybytes() if len(ids) and taken.buffers()[2] else b""
        return [data[a + (data[a : a + 1] == b" ") : b].decode(errors="replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def decode(self, ids: list[int]) -> str:
        known = np.array([k for k in ids if k < len(self.bytes_of)], np.int32)
        return self.decode_all(known, np.array([0, len(known)]))[0]

    def joined(self, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """Each run of ids as decimal numbers with commas."""
        if len(ids) > LONG_IDS:  # beyond the offsets of Arrow's strings
            return pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:])], pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), self.written.take(pa.array(ids))), ",")


_codecs: dict[str, PieceCodec] = {}
caches[__name__] = _codecs.clear


def encode_documents(docs: DataFrame, model_path: str, carry: list[str] | None = None, text_col: str = "text", as_array: bool = False) -> DataFrame:
    """``record`` (the columns in ``carry``, by default all), with ``ids``, ``n_tokens`` and ``decoded``.

    ``ids`` is decimal text joined by commas, or an array of integers.  The model is read by the
    driver and sent to the workers (half a megabyte).
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(load_model(model_path))
    carry = docs.columns if carry is None else carry
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("record"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _codecs:
            _codecs[model_path] = PieceCodec(model.value)
        codec = _codecs[model_path]
        for batch in batches:
            texts = raw_texts(batch.column(1))
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and size < GROUP_BYTES:
                    size += len(texts[hi] or b"")
                    hi += 1
                ids, cuts = codec.run([(t or b"").decode(errors="replace") for t in texts[lo:hi]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids)) if as_array else codec.joined(ids, cuts),
                        pa.array(np.diff(cuts)),
                        pa.array(codec.decode_all(ids, cuts), pa.string()),
                    ],
                    names=["record", "ids", "n_tokens", "decoded"],
                )
                lo = hi

    schema = T.StructType(
        [nested.schema["record"], T.StructField("ids", T.ArrayType(T.IntegerType()) if as_array else T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]
    )
    return map_batches(nested, run, schema)

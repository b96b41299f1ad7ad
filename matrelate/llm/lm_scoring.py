"""Language-model scoring with a smoothed trigram model in Elias-Fano tries.

Counts cover every training token.

1. Each block asks for its own words and learns their training counts and ids;
   frequent words get small ids.  The block is then written again with ids in
   place of words.
2. Each block asks for its distinct trigrams, grouped by their last two words.
   A shard gathers what the training blocks counted and builds one trie with
   the levels v, vw and uvw (uvw is found below vw, its longest suffix):
   level v holds the back-off weight of v, level vw the smoothed probability
   of w after v and the back-off weight of the context vw, level uvw the
   smoothed probability of w after uv, over the back-off weight of uv.  All
   values are quantised logarithms.  The trie is written to files, mapped into
   memory and answers, by successor search below each context, every distinct
   bigram and trigram that any block asked for.
3. The block adds up its documents' scores.

Each order interpolates with the one below by a Dirichlet prior:
p(w|v) = (c(vw) + PRIOR p(w)) / (c(v) + PRIOR) and
p(w|uv) = (c(uvw) + PRIOR3 p(w|v)) / (c(uv) + PRIOR3), with
p(w) = (c(w) + 1) / (N + V + 1), the rest going to unknown words.  An n-gram
without count backs off by PRIOR / (c + PRIOR) of its context.  A text starts
in the context "start", from where bigrams are used, and closes with "end".

Shards split trigrams by their last two words.  A pair that makes more than
``HOT_SHARE`` of all tokens is split by the third word too; its count is summed
beforehand, and at most 1 / ``HOT_SHARE`` pairs can be that frequent.

Defined results: a null or empty text is scored as "end" alone; rows that are
not for training get scores but add no counts; an empty training set gives
every token probability 1 / 1; repeated rows count each time; null ids and
other columns are carried or ignored.
"""

from __future__ import annotations

import io
import tarfile
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import answered, ask, build_blocks, open_block, rows_of, shard_bounds, shard_count, with_answers
from .common import bundle, map_batches, materialize, mix64, pack, passing, unbundle, unpack
from .elias_fano import NgramTrie

PRIOR, PRIOR3 = 300.0, 10.0
#: Word pairs of more than this share of the training tokens are split over all shards.
HOT_SHARE = 1e-3
#: Quantised log10 values: steps per unit, the highest value, and the code for "not in the trie".
STEPS, TOP = 2048, 15.0
MISSING = 65535
#: Ids of the start and end of a text; words come after.
START_ID, FIRST_ID = 0, 1
#: Blocks are this much smaller than elsewhere, as their trigrams take several numbers a word.
BLOCK_SHARE = 0.75
#: The end of a text as a vocabulary entry; no word holds a blank.
END_KEY = np.uint64(xxhash.xxh3_64_intdigest(b" end "))

VOCABULARY = "block long, shard int, keys binary, counts binary"
CODED = "block long, words long, doc_ids array<long>, lengths binary, trained binary, tokens binary, ids binary, counts binary, pairs binary"
SENT = "block long, shard int, grams binary"
OUT_SCHEMA = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def quantised(logs: np.ndarray) -> np.ndarray:
    """Codes of log10 values; 0 is the highest."""
    return np.clip(np.rint((TOP - logs) * STEPS), 0, MISSING - 1).astype(np.uint16)


def logs_of(codes: np.ndarray) -> np.ndarray:
    return TOP - codes.astype(np.float64) / STEPS


# -- words -----------------------------------------------------------------


def _words(block, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary keys in order (the end among them), training counts, and each local code's place; the end's code is last."""
    weights = np.repeat(trained, block.lengths)
    size = len(block.vocabulary)
    counts = np.bincount(block.codes[weights], minlength=size + 1) if len(block.codes) else np.zeros(size + 1, np.int64)
    counts[size] = trained.sum()
    keys = np.append(block.word_hashes(), END_KEY)
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return keys[order], counts[order].astype(np.uint32), place


def _count_words(shard: int, rows: list[dict], shards: int) -> list[bytes]:
    """Total count and id of each word sent to the shard; then the shard's training tokens, distinct training words and largest id."""
    keys = [np.cumsum(unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate([unpack(r["counts"], np.uint32) for r in rows]), len(every)).astype(np.int64)
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(every))  # frequent words get small ids
    ids = rank * shards + shard + FIRST_ID
    cuts = np.cumsum([0, *map(len, keys)])
    count, ids_ = total[place], ids[place]
    answers = [bundle(count[a:b], ids_[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return answers + [pack(np.array([total.sum(), np.count_nonzero(total), ids.max(initial=0)]))]


def _code(row: dict, trained: np.ndarray, frequent: float) -> pa.RecordBatch:
    """A block with its words renumbered in the order of their ids, an end after each document, and its frequent pairs counted."""
    block = open_block(row)
    _, _, place = _words(block, trained)
    parts = [unbundle(a["answer"], np.int64, np.int64) for a in row["vocabulary_counts"]]
    count, ids = (np.concatenate([p[k] for p in parts])[place] for k in (0, 1))
    end = len(block.vocabulary)
    order = np.argsort(ids)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(1, len(order) + 1)
    n_docs = len(block.lengths)
    token = np.full(len(block.codes) + n_docs, end, np.int64)
    token[np.arange(len(block.codes)) + np.repeat(np.arange(n_docs), block.lengths)] = block.codes
    token = number[token]
    # the start is number 0, its count that of the ends
    ids = np.concatenate([[START_ID], ids[order]])
    counts = np.concatenate([[count[end]], count[order]])
    coded = _Coded(block.number, block.doc_ids, block.lengths + 1, trained, token, ids, counts)
    cells = [
        block.number, len(token), block.doc_ids, pack(coded.lengths.astype(np.uint32)), np.packbits(trained).tobytes(), pack(token.astype(np.uint32)),
        pack(np.diff(ids, prepend=0)), pack(counts), bundle(*coded.frequent_pairs(frequent)),
    ]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=[f.split()[0] for f in CODED.split(", ")])


class _Coded:
    """A block in numbers: every document's tokens in a row, its end among them; number 0 is the start."""

    def __init__(self, number, doc_ids, lengths, trained, token, ids, counts):
        self.number, self.doc_ids, self.lengths, self.trained = number, doc_ids, lengths, trained
        self.token, self.ids, self.counts = token, ids, counts
        self.firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], token[:-1]]) if len(token) else token
        self.before[self.firsts] = 0

    @classmethod
    def open(cls, row: dict) -> _Coded:
        lengths = unpack(row["lengths"], np.uint32).astype(np.int64)
        trained = np.unpackbits(np.frombuffer(row["trained"], np.uint8), count=len(lengths)).astype(bool)
        token = unpack(row["tokens"], np.uint32).astype(np.int64)
        return cls(row["block"], row["doc_ids"], lengths, trained, token, np.cumsum(unpack(row["ids"], np.int64)), unpack(row["counts"], np.int64))

    def frequent_pairs(self, limit: float) -> list[np.ndarray]:
        """Ids and training count in this block of pairs of words that are both more frequent than ``limit``."""
        hot = np.flatnonzero(self.counts > limit)
        place = np.full(len(self.counts), -1, np.int64)
        place[hot] = np.arange(len(hot))
        a, b = place[self.before], place[self.token]
        n = np.bincount((a * len(hot) + b)[(a >= 0) & (b >= 0) & np.repeat(self.trained, self.lengths)], minlength=len(hot) ** 2)
        some = np.flatnonzero(n)
        return [self.ids[hot[some // max(len(hot), 1)]], self.ids[hot[some % max(len(hot), 1)]], n[some]]


# -- bigrams and trigrams -----------------------------------------------------


class _Pairs:
    """Word pairs whose number of tokens is known to all, by ids."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        self.v, self.w, self.n = (np.array([r[k] for r in rows], np.int64) for k in range(3))

    def of(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The count of each pair, -1 where it is not listed."""
        out = np.full(len(v), -1, np.int64)
        some = np.flatnonzero(np.isin(v, self.v) & np.isin(w, self.w))
        table = {(a, b): n for a, b, n in zip(self.v.tolist(), self.w.tolist(), self.n.tolist())}
        out[some] = [table.get(x, -1) for x in zip(v[some].tolist(), w[some].tolist())]
        return out


class _Grams:
    """A block's distinct bigrams and, below each, its trigrams, in the order in which they are asked for."""

    def __init__(self, c: _Coded, hot: _Pairs, shards: int):
        self.c = c
        pair, self.place2 = np.unique((c.before << 32) | c.token, return_inverse=True)
        self.v, self.w = pair >> 32, pair & 0xFFFFFFFF
        del pair
        earlier = np.concatenate([[0], c.before[:-1]]) if len(c.token) else c.token
        earlier[c.firsts] = 0
        triple, self.place3 = np.unique((self.place2 << 32) | earlier, return_inverse=True)
        self.owner, self.u = triple >> 32, triple & 0xFFFFFFFF
        del triple, earlier
        self.seen = np.bincount(self.place3, np.repeat(c.trained, c.lengths), len(self.u)).astype(np.int64)
        v_id, w_id, u_id = c.ids[self.v], c.ids[self.w], c.ids[self.u]
        self.split = hot.of(v_id, w_id) >= 0
        split = self.split[self.owner]
        mixed = mix64(v_id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w_id.astype(np.uint64))[self.owner]
        mixed[split] = mix64(mixed[split] + u_id[split].astype(np.uint64))
        shard = ((mixed >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
        # a stable sort leaves the ids of a shard in order
        self.order = np.argsort(shard, kind="stable")
        self.bounds = np.searchsorted(shard[self.order], np.arange(shards + 1))

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Each shard's trigrams, and its bigrams with the number of trigrams of each."""
        for s in np.flatnonzero(np.diff(self.bounds)).tolist():
            tri = self.order[self.bounds[s] : self.bounds[s + 1]]
            owner = self.owner[tri]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            yield s, tri, owner[first], np.diff(np.append(first, len(tri)))

    def send(self, unigram: np.ndarray, kind) -> Iterator[pa.RecordBatch]:
        c, shards, blobs = self.c, [], []
        for s, tri, bi, runs in self.parts():
            # what a trie needs comes with training counts, and with split pairs, which any shard may be asked for
            trained = (np.add.reduceat(self.seen[tri], np.cumsum(runs) - runs) > 0) | self.split[bi]
            v, w = self.v[bi], self.w[bi]
            shards.append(s)
            blobs.append(bundle(
                np.diff(c.ids[v], prepend=0), c.ids[w].astype(kind), np.where(trained, c.counts[v], 0), np.where(trained, unigram[w], 0).astype(np.uint16),
                runs.astype(np.uint32), c.ids[self.u[tri]].astype(kind), self.seen[tri].astype(np.uint32),
            ))
        yield pa.RecordBatch.from_arrays([pa.array([c.number] * len(shards), pa.int64()), pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "shard", "grams"])


def _ranked(x: np.ndarray) -> np.ndarray:
    """Numbers in the same order below 2^32."""
    return x if not len(x) or x.max() < 1 << 32 else np.unique(x, return_inverse=True)[1]


def _answer_grams(rows: list[dict], kind, hot: _Pairs, priors: tuple[float, float], keep: bool) -> list[bytes]:
    """Builds the shard's trie from the training counts and looks up every bigram and trigram that was asked for."""
    got = [unbundle(r["grams"], np.int64, kind, np.int64, np.uint16, np.uint32, kind, np.uint32) for r in rows]
    v = np.concatenate([np.cumsum(g[0]) for g in got])
    w, v_count, unigram, runs, u, seen = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in range(1, 7))
    sizes = [(len(g[4]), len(g[5])) for g in got]
    del got
    _, first2, same2 = np.unique((_ranked(v) << 32) | _ranked(w), return_index=True, return_inverse=True)
    owner = np.repeat(same2, runs)
    triple, first3, same3 = np.unique((owner << 32) | _ranked(u), return_index=True, return_inverse=True)
    above, u3 = triple >> 32, u[first3]
    c3 = np.bincount(same3, seen, len(triple)).astype(np.int64)
    v2, w2 = v[first2], w[first2]
    known = hot.of(v2, w2)
    c2 = np.where(known >= 0, known, np.bincount(above, c3, len(v2)).astype(np.int64))
    # blocks send a word's count and probability along with what they trained
    v_total, w_log = np.zeros(len(v2), np.int64), np.zeros(len(v2), np.int64)
    some = np.flatnonzero(v_count)
    v_total[same2[some]], w_log[same2[some]] = v_count[some], unigram[some]

    tri = np.flatnonzero(c3)  # the trie's own n-grams
    in_trie = known >= 0
    in_trie[above[tri]] = True
    bi = np.flatnonzero(in_trie)
    node2 = np.cumsum(in_trie) - 1
    new = np.concatenate([[True], v2[bi][1:] != v2[bi][:-1]]) if len(bi) else np.zeros(0, bool)
    prior, prior3 = priors
    p2 = (c2[bi] + prior * 10.0 ** logs_of(w_log[bi])) / (v_total[bi] + prior)
    p3 = (c3[tri] + prior3 * p2[node2[above[tri]]]) / prior3
    nodes = [(np.zeros(new.sum(), np.int64), v2[bi][new]), (np.cumsum(new) - 1, w2[bi]), (node2[above[tri]], u3[tri])]
    values = [
        {"backoff": quantised(np.log10(prior / (v_total[bi][new] + prior)))},
        {"value": quantised(np.log10(p2)), "backoff": quantised(np.log10(prior3 / (c2[bi] + prior3)))},
        {"value": quantised(np.log10(p3))},
    ]
    with tempfile.TemporaryDirectory() as folder:
        NgramTrie.build(nodes, values, folder)
        stored = _archive(folder) if keep else None
        trie = NgramTrie.load(folder)
        value2, backoff, value3 = _look_up(trie, v2, w2, above, u3)
    out = [bundle(a, b, c) for a, b, c in zip(*(_cut(x, [n[k] for n in sizes]) for x, k in ((value2[same2], 0), (backoff[same2], 0), (value3[same3], 1))))]
    return out + [stored] if keep else out


def _look_up(trie: NgramTrie, v: np.ndarray, w: np.ndarray, above: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of bigrams (v, w): value and back-off; and of the trigrams with ``u`` before the bigram ``above``: value."""
    first = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    root = trie.children(0, np.zeros(first.sum(), np.int64), v[first])
    at2 = trie.children(1, root[np.cumsum(first) - 1], w)
    at3 = trie.children(2, at2[above], u)
    value = lambda level, name, at: np.where(at >= 0, trie.values[level][name][at] if len(trie.values[level][name]) else MISSING, MISSING).astype(np.uint16)
    return value(1, "value", at2), value(1, "backoff", at2), value(2, "value", at3)


def _cut(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def _archive(folder: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        tar.add(folder, ".")
    return out.getvalue()


def open_trie(archive: bytes, folder: str) -> NgramTrie:
    """A trie of a stored model, unpacked to ``folder`` and mapped into memory."""
    with tarfile.open(fileobj=io.BytesIO(archive)) as tar:
        tar.extractall(folder, filter="data")
    return NgramTrie.load(folder)


# -- documents ----------------------------------------------------------------


def score_documents(
    docs: DataFrame, is_training: Callable[[list], np.ndarray], priors: tuple[float, float] = (PRIOR, PRIOR3), id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None
) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score (unigrams) and score (the model), in log10.

    ``is_training`` maps a list of ids to an array of booleans.  ``model_path``
    asks for the tries to be stored there: (shard, trie), see ``open_trie``.
    """
    spark = docs.sparkSession
    with passing(spark):
        coded, n_tokens, n_words, kind = _coded_blocks(docs, is_training, id_col, text_col)
    hot = _hot_pairs(coded, HOT_SHARE * n_tokens)
    shards = shard_count(coded, 1.2)
    base = lambda counts: np.log10((counts + 1) / (n_tokens + n_words + 1))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            c = _Coded.open(row)
            yield from _Grams(c, hot, shards).send(quantised(base(c.counts)), kind)

    sent = map_batches(coded.drop("pairs"), grams, SENT)
    answers = ask(sent, lambda shard, rows: _answer_grams(rows, kind, hot, priors, model_path is not None), "grams")
    if model_path is not None:
        answers.where("block < 0").select("shard", F.col("answer").alias("trie")).write.parquet(model_path)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            c = _Coded.open(row)
            yield _score(row, _Grams(c, hot, shards), base(c.counts), n_tokens, priors[0])

    return map_batches(with_answers(coded.drop("pairs"), answers=answers), score, OUT_SCHEMA)


def _coded_blocks(docs: DataFrame, is_training, id_col: str, text_col: str):
    """Stored blocks in ids, training tokens, distinct training words, and the type that holds ids."""
    blocks = build_blocks(docs, lower=True, id_col=id_col, text_col=text_col, share=BLOCK_SHARE)
    shards = shard_count(blocks, 0.2)
    training = lambda row: is_training(row["doc_ids"]) if len(row["doc_ids"]) else np.zeros(0, bool)

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys, counts, _ = _words(open_block(row), training(row))
            bounds = shard_bounds(keys, shards)
            some = np.flatnonzero(np.diff(bounds))
            spans = [slice(bounds[s], bounds[s + 1]) for s in some]
            cells = [
                pa.array([row["block"]] * len(some), pa.int64()),
                pa.array(some, pa.int32()),
                pa.array([pack(np.diff(keys[x], prepend=np.uint64(0))) for x in spans], pa.binary()),
                pa.array([pack(counts[x]) for x in spans], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cells, names=["block", "shard", "keys", "counts"])

    counted = ask(map_batches(blocks, vocabulary, VOCABULARY), lambda shard, rows: _count_words(shard, rows, shards), "vocabulary")
    n_tokens = n_words = top = 0
    for r in counted.where("block < 0").select("answer").toLocalIterator():  # three numbers a shard
        tokens, words, largest = unpack(r["answer"], np.int64).tolist()
        n_tokens, n_words, top = n_tokens + tokens, n_words + words, max(top, largest)

    frequent = HOT_SHARE * n_tokens

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield _code(row, training(row), frequent)

    coded = materialize(map_batches(with_answers(blocks, vocabulary_counts=counted), code, CODED), "coded", keep=True)
    return coded, n_tokens, n_words, np.uint32 if top < 1 << 32 else np.uint64


def _hot_pairs(coded: DataFrame, limit: float) -> _Pairs:
    """Pairs of more than ``limit`` training tokens, summed from what the blocks counted."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in unbundle(blob, np.int64, np.int64, np.int64)], names=["v", "w", "n"])

    sums = map_batches(coded.select("pairs"), spread, "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))
    return _Pairs([tuple(r) for r in sums.where(F.col("n") > limit).collect()])  # 1 / HOT_SHARE rows at most


def _score(row: dict, g: _Grams, unigram: np.ndarray, n_tokens: int, prior: float) -> pa.RecordBatch:
    c = g.c
    parts = [unbundle(a["answer"], np.uint16, np.uint16, np.uint16) for a in row["answers"] or []]
    value2, backoff = np.full(len(g.v), MISSING, np.uint16), np.full(len(g.v), MISSING, np.uint16)
    value3 = np.full(len(g.u), MISSING, np.uint16)
    for (_, tri, bi, _), (a, b, x) in zip(g.parts(), parts):
        value2[bi], backoff[bi], value3[tri] = a, b, x
    seldom = np.log10(prior / (c.counts[g.v] + prior)) + unigram[g.w]
    log2 = np.where(value2 == MISSING, seldom, logs_of(value2))
    back = np.where(backoff == MISSING, 0.0, logs_of(backoff))
    # a token after the first: context uv is the pair that ends at the token before
    context = np.concatenate([[0], g.place2[:-1]]) if len(g.place2) else g.place2
    logs = np.where(value3[g.place3] == MISSING, log2[g.place2], logs_of(value3)[g.place3]) + back[context]
    logs[c.firsts] = log2[g.place2[c.firsts]]
    sums = lambda x: np.add.reduceat(x, c.firsts) if len(c.firsts) else np.zeros(0)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(c.doc_ids, pa.int64()),
            pa.array(c.lengths, pa.int64()),
            pa.array(sums((c.counts[c.token] > 0).astype(np.int64)), pa.int64()),
            pa.array([n_tokens] * len(c.firsts), pa.int64()),
            pa.array(sums(unigram[c.token]), pa.float64()),
            pa.array(sums(logs), pa.float64()),
        ],
        names=[f.split()[0] for f in OUT_SCHEMA.split(", ")],
    )

import math
from collections import Counter

import numpy as np
import pytest
from conftest import frame, invented

from matrelate.llm import blocks, lm_scoring
from matrelate.llm.elias_fano import EliasFano, NgramTrie, level_nodes


def training(ids):
    return np.array([i is not None and i % 3 != 2 for i in ids], bool)


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, prior, prior3):
    import re

    texts = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]) for i, t in rows]
    train = [w for i, w in texts if training([i])[0]]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for w in train for p in zip([0, *w], w))
    triples = Counter(p for w in train for p in zip([0, *w], w, w[1:]))
    c[0] = len(train)
    base = lambda w: math.log10((c[w] + 1) / (n + v + 1))
    two = lambda a, b: (pairs[a, b] + prior * 10 ** base(b)) / (c[a] + prior)
    three = lambda a, b, d: (triples[a, b, d] + prior3 * two(b, d)) / (pairs[a, b] + prior3)
    out = []
    for i, w in texts:
        score = math.log10(two(0, w[0])) + sum(math.log10(three(a, b, d)) for a, b, d in zip([0, *w], w, w[1:]))
        out.append((i, len(w), sum(c[x] > 0 for x in w), n, sum(map(base, w)), score))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words, hot", [(1_200_000, 1e-3), (120, 0.0), (120, 0.02), (120, 1.0)])
def test_against_brute_force(spark, corpus, monkeypatch, tmp_path, block_words, hot):
    monkeypatch.setattr(blocks, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(lm_scoring, "HOT_SHARE", hot)
    rows = [*corpus, *((100 + k, invented(k % 9, 80)) for k in range(30)), *((200 + k, "very common pair " * 20 + invented(k % 4, 9)) for k in range(12))]
    out = lm_scoring.score_documents(frame(spark, rows), training, model_path=f"{tmp_path}/model")
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = brute(rows, lm_scoring.PRIOR, lm_scoring.PRIOR3)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert abs(g[4] - w[4]) < 1e-6 * max(1, abs(w[4]))
        # two quantised values a token
        assert abs(g[5] - w[5]) <= 1.0 / lm_scoring.STEPS * w[1] + 1e-6
    stored = spark.read.parquet(f"{tmp_path}/model").collect()
    tries = [lm_scoring.open_trie(r["trie"], tmp_path / str(k)) for k, r in enumerate(stored)]
    known = [t.translate(LOWER).split() for i, t in rows if t and training([i])[0]]
    wanted = {p for w in known for p in zip([0, 0, *w], [0, *w, None], [*w, None])} | {(0, 0, None)}
    assert all(len(t.levels) == 3 for t in tries) and sum(len(t.values[2]["value"]) for t in tries) == len(wanted)


@pytest.mark.parametrize("context", [("a", "b"), ("b", "a"), ("x", "b"), ("a", "x")])
def test_model_is_normalised(context):
    """Over all continuations of a context, known words and one unknown, probabilities sum to one."""
    text = "a b a c a b d a b a".split()
    c, pairs = Counter([*text, None]), Counter(zip([0, *text], [*text, None]))
    triples = Counter(zip([0, *text], text, [*text[1:], None]))
    n, v, prior, prior3 = sum(c.values()), len(c), lm_scoring.PRIOR, lm_scoring.PRIOR3
    x, y = context
    two = lambda w: (pairs[y, w] + prior * (c[w] + 1) / (n + v + 1)) / (c[y] + prior)
    total = sum((triples[x, y, w] + prior3 * two(w)) / (pairs[x, y] + prior3) for w in [*c, "unknown"])
    assert abs(total - 1) < 1e-12


def test_seen_text_scores_above_the_base(spark):
    rows = [(k, invented(k % 4, 60)) for k in range(0, 60)]
    out = lm_scoring.score_documents(frame(spark, rows), training).collect()
    assert all(r["score"] > r["base_score"] for r in out)


def test_no_rows_and_no_training_rows(spark):
    assert lm_scoring.score_documents(frame(spark, []), training).count() == 0
    out = lm_scoring.score_documents(frame(spark, [(2, "a b"), (5, None)]), training).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out) == [(2, 3, 0, 0, 0, 0), (5, 1, 0, 0, 0, 0)]


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1, 9), (1000, 10), (5000, 10**12), (3000, 2**61), (70_000, 90_000)])
def test_elias_fano(n, top):
    r = np.random.default_rng(n)
    values = np.sort(r.integers(0, top, n))
    seq = EliasFano.build(values)
    if n:
        assert (seq.get(np.arange(n)) == values).all()
        asked = r.integers(0, top + 3, 3000)
        span = np.sort(r.integers(0, n + 1, (3000, 2)), axis=1)
        want = [a + np.searchsorted(values[a:z], x) for x, (a, z) in zip(asked, span)]
        assert (seq.successor(asked, span[:, 0], span[:, 1]) == np.array(want)).all()


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_trie(tmp_path, order):
    r = np.random.default_rng(order)
    grams = np.unique(r.integers(0, 30, (6000, order)), axis=0)
    codes = r.integers(0, 60_000, len(grams)).astype(np.uint16)
    NgramTrie.build(level_nodes(grams), [{}] * (order - 1) + [{"code": codes}], str(tmp_path))
    table = {tuple(g): k for k, g in enumerate(grams.tolist())}
    asked = r.integers(0, 33, (5000, order))
    trie = NgramTrie.load(str(tmp_path))
    assert (trie.values[-1]["code"] == codes).all()
    for query in (asked, asked[np.lexsort(asked.T[::-1])], grams):
        assert trie.find(query).tolist() == [table.get(tuple(q), -1) for q in query.tolist()]


def test_trie_with_childless_nodes(tmp_path):
    nodes = [(np.zeros(3, np.int64), np.array([2, 5, 9])), (np.array([0, 0, 2]), np.array([1, 7, 4]))]
    NgramTrie.build(nodes, [{}, {}], str(tmp_path))
    asked = np.array([[2, 1], [2, 7], [5, 1], [5, 8], [9, 4], [9, 1], [3, 1]])
    assert NgramTrie.load(str(tmp_path)).find(asked).tolist() == [0, 1, -1, -1, 2, -1, -1]

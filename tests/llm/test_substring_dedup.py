import re
from collections import Counter

import numpy as np
import pytest
from conftest import frame, invented

from matrelate.llm import blocks, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[p : p + length]) for w in words for p in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p : p + length])] > 1:
                gone.update(range(p, p + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def run(spark, rows, length, **options):
    out = substring_dedup.find_repeats(frame(spark, rows), length, **options).collect()
    assert all(sum(s["end"] - s["start"] for s in r["repeats"]) + len(r["kept"].split()) == r["n_words"] for r in out)
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["repeats"]), r["kept"]) for r in out), key=str)


@pytest.mark.parametrize("length", [35, 12, 10, 3, 1])
def test_corpus(spark, corpus, monkeypatch, length):
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 150)
    assert run(spark, corpus, length) == brute(corpus, length)


def test_periodic_and_touching_repeats(spark):
    a, b = invented(1, 40), invented(2, 40)
    rows = [(1, "x " * 200), (2, f"{a} {b}"), (3, f"{b} {a}"), (4, f"{a[:-1]}! {b}"), (5, a + " q " + a), (6, "y " * 34)]
    assert run(spark, rows, 35) == brute(rows, 35)


@pytest.mark.parametrize("bits", [1, 6, 12])
def test_hashes_that_collide(spark, corpus, monkeypatch, bits):
    """Different windows of one hash are told apart by their words."""
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 300)
    rows = [r for r in corpus if len(r[1] or "") < 3000]
    assert run(spark, rows, 12, bits=bits) == brute(rows, 12)


def test_matches_are_extended(spark):
    """Windows that go on beside their partners become one stretch."""
    starts, blocks_, places = (np.array(x) for x in ([3, 4, 5, 9, 10, 11], [1, 1, 1, 1, 1, 2], [7, 8, 9, 2, 3, 4]))
    first, n = substring_dedup._stretches(starts, blocks_, places)
    assert first.tolist() == [0, 3, 5] and n.tolist() == [3, 2, 1]


def test_shared_passage(spark):
    passage = invented(3, 60)
    rows = [(k, f"{invented(100 + k, 30)} {passage} {invented(900 + k, 30)}") for k in range(80)]
    assert run(spark, rows, 35) == brute(rows, 35)


def test_empty(spark):
    assert run(spark, [], 35) == []
    assert run(spark, [(1, None), (2, "")], 35) == [(1, 0, 0, ""), (2, 0, 0, "")]


def test_equal_windows_choose_the_same_anchor():
    text = invented(4, 100).encode().split()
    vocabulary = sorted(set(text))
    code = {w: k for k, w in enumerate(vocabulary)}
    codes = np.array([code[w] for w in [b"q"] * 0 + text[:70] + text[20:90]], np.int32)
    block = blocks.Block(0, [1, 2], np.array([70, 70]), codes, vocabulary)
    seq, starts, anchor = substring_dedup.windows(block, 35)
    places = dict(zip(starts.tolist(), (anchor - starts).tolist()))
    assert all(places[p] == places[70 + p - 20] for p in range(20, 36))
    hashes = dict(zip(starts.tolist(), seq.at(starts, 35).tolist()))
    assert all(hashes[p] == hashes[70 + p - 20] for p in range(20, 36))

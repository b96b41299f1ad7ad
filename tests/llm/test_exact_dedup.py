from collections import defaultdict

import pytest
from conftest import frame
from pyspark.sql import functions as F

from matrelate.llm import exact_dedup


def expected(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        known = [x for x in groups[t or ""] if x is not None]
        keep = pick(known) if known else None
        out.append((i, keep, len(groups[t or ""]), i == keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep, pick", [("min", min), ("max", max)])
def test_groups(spark, corpus, keep, pick):
    found = exact_dedup.deduplicate(frame(spark, corpus), keep)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()), key=str)
    assert got == expected(corpus, pick)


def test_weak_digest_is_verified_by_bytes(spark, corpus):
    """With a digest that nearly all texts share, texts are still told apart."""
    weak = lambda text: F.unhex(F.hex(F.length(text) % 2))
    found = exact_dedup.deduplicate(frame(spark, corpus), "min", digest=weak)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()), key=str)
    assert got == expected(corpus, min)


def test_drop_duplicates(spark, corpus):
    docs = frame(spark, corpus)
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    texts = [r["text"] or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {t or "" for _, t in corpus}


def test_empty(spark):
    docs = frame(spark, [])
    assert exact_dedup.deduplicate(docs).count() == 0
    assert exact_dedup.drop_duplicates(docs).count() == 0


def test_index_over_batches(spark):
    index = exact_dedup.DigestIndex(spark, keep="min")
    index.flush(frame(spark, [(5, "a"), (6, "b")]))
    index.flush(frame(spark, [(1, "b"), (7, "c")]))
    assert {r["id"]: r["n"] for r in index.compact().collect()} == {5: 1, 1: 2, 7: 1}
    index.flush(frame(spark, [(0, "c")]))
    assert sorted(r["id"] for r in index.find(["c", "a", "none"]).collect()) == [0, 5, 7]
    index.compact()
    found = index.lookup(frame(spark, [(100, "c"), (101, "z")]))
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in found.collect()} == {100: (0, 2), 101: (None, None)}

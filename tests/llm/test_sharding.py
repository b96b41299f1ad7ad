from collections import Counter

import pytest
from conftest import frame

from matrelate.llm import sharding


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_counts_slots_and_content(spark, corpus, shards):
    out = sharding.shuffle_into_shards(frame(spark, corpus), shards, bucket_bytes=10_000).collect()
    assert Counter((r["record"]["doc_id"], r["record"]["text"]) for r in out) == Counter(corpus)
    sizes = Counter(r["shard"] for r in out)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))


def test_seed_decides(spark, corpus):
    docs = frame(spark, [(k, "t") for k in range(200)])
    order = lambda seed: [r["record"]["doc_id"] for r in sharding.shuffle_into_shards(docs, 2, seed=seed).orderBy("shard", "slot").collect()]
    assert order(1) == order(1) != order(2)
    assert order(1) != sorted(order(1))


def test_order_is_spread(spark):
    """Neighbours in the input are not neighbours in the output."""
    docs = frame(spark, [(k, "t") for k in range(2000)])
    order = [r["record"]["doc_id"] for r in sharding.shuffle_into_shards(docs, 4, bucket_bytes=3000).orderBy("shard", "slot").collect()]
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:])) < 20
    assert abs(sum(order[:500]) / 500 - 1000) < 120


def test_empty(spark):
    assert sharding.shuffle_into_shards(frame(spark, []), 40).count() == 0


def test_write(spark, tmp_path):
    sharding.write_shards(sharding.shuffle_into_shards(frame(spark, [(k, "t") for k in range(50)]), 5), f"{tmp_path}/out")
    assert {r["shard"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().collect()} == dict.fromkeys(range(5), 10)

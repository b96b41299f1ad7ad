import math

import numpy as np
from conftest import frame, invented

from matrelate.llm import importance, queries


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(importance, "LAST", 5)
    monkeypatch.setattr(importance, "BINS", 8)
    values = [float(x) for x in np.random.default_rng(1).normal(size=300)] + [0.25] * 40 + [9.0, 9.0]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 3, 50, 150, 200, 341):
        assert importance.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(keys, 342) == -math.inf and importance.kth_largest(keys, 0) == math.inf


def test_junk_goes_and_good_texts_stay(spark):
    good = [(k, invented(k, 80)) for k in range(120)]
    junk = [(1000 + k, " ".join(w + "$$$ ###" for w in invented(500 + k, 40).split())) for k in range(40)]
    docs = frame(spark, good + junk)
    target = spark.createDataFrame([(k,) for k in range(60)], "doc_id long")
    out = {r["doc_id"]: r["kept"] for r in importance.resample(docs, target, keep=0.75).collect()}
    assert sum(out.values()) == 120
    assert not any(kept for i, kept in out.items() if i >= 1000)


def test_ratio_matches_brute_force(spark):
    rows = [(k, invented(k, 30)) for k in range(20)]
    target = spark.createDataFrame([(3,), (3,), (4,), (999,), (None,)], "doc_id long")
    got = importance.fit(frame(spark, rows), target)
    count = lambda ids: sum((np.bincount(importance.features(t.encode()), minlength=importance.BUCKETS) for i, t in rows if i in ids), np.zeros(importance.BUCKETS))
    raw, good = count(range(20)), count((3, 4))
    share = lambda x: (x + 1) / (x.sum() + importance.BUCKETS)
    assert np.allclose(got, np.log(share(good) / share(raw)))


def test_sampling_follows_importance(spark):
    """Gumbel keys rank rows of equal importance at random, and larger ones first more often."""
    docs = frame(spark, [(k, None) for k in range(2000)])
    keys = importance.weigh(docs, np.zeros(importance.BUCKETS)).toPandas()
    assert abs(keys["key"].mean() - 0.5772) < 0.12 and keys["log_weight"].eq(0).all()


def test_tables(spark, corpus):
    docs = frame(spark, corpus)
    none = spark.createDataFrame([], "doc_id long")
    out = importance.resample(docs, none, keep=1.0).collect()
    assert len(out) == len(corpus) and all(r["kept"] for r in out)
    assert importance.resample(frame(spark, []), none, keep=0.5).count() == 0


def test_query_keeps_the_share_of_its_target(spark, tmp_path):
    """The kept share follows good and non-toxic labels, as the target does."""
    frame(spark, [(k, invented(k, 20)) for k in range(40)]).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k < 30), int(k < 10)) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.op6_quality(spark, str(tmp_path)).where("kept").count() == 20

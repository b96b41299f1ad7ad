import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

import corpus_pipeline
from matrelate.llm import language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.fit(docs.where(~held))
    assert model.languages == ["de", "en", "es", "fr"]
    out = language_id.identify(docs.where(held), model)
    right, n = out.agg(F.sum((F.col("record.lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.98
    assert out.agg(F.min("score"), F.max("score")).first()[1] <= 1


@pytest.fixture(scope="module")
def model():
    text = {"en": b"the thing with the other thing that was there and then " * 30, "fr": "une chose avec les autres choses dans la maison été où ".encode() * 30}
    parts = {}
    for lang, t in text.items():
        keys, n = np.unique(language_id._grams([language_id._prepare(t)])[0], return_counts=True)
        parts[lang] = [(keys, n.astype(np.int64))]
    return language_id._model(parts, {"en": 5, "fr": 9})


def test_texts(model):
    texts = [b"That other THING was there", "une autre maison où".encode(), None, b"", b"123 ... !!", "漢字".encode(), b"q", b"there " * 30_000, b"the thing the thing 99 une"]
    got = model.predict(texts)
    assert [g for g, _ in got] == ["en", "fr", "und", "und", "und", "fr", "fr", "en", "en"]
    assert all(0 <= s <= 1 for _, s in got) and got[5][1] == got[6][1] == 0 and got[7][1] > 0.9
    # texts do not leak into their neighbours
    assert [model.predict([t])[0] for t in texts] == got


def test_false_positives_are_corrected(model):
    noise = np.random.default_rng(1).integers(97, 123, 60_000).astype(np.uint8)
    noise[::7] = 32
    (_, score), = model.predict([noise.tobytes()])
    assert score < 0.02


def test_many_languages():
    names = [f"l{k:03d}" for k in range(70)]
    parts = {x: [(np.arange(k * 50, k * 50 + 50).astype(np.uint64) + 1, np.full(50, 9))] for k, x in enumerate(names)}
    model = language_id._model(parts, dict.fromkeys(names, 1))
    assert len(model.slices) == 2 and model.languages == names
    keys = np.arange(66 * 50, 66 * 50 + 50).astype(np.uint64) + 1
    shares = np.concatenate([s.count(keys, np.array([0, 50])) for s in model.slices], axis=1)
    assert shares[0].argmax() == 66


def test_tables(spark, corpus):
    docs = frame(spark, corpus)
    model = language_id.fit(docs)
    out = language_id.identify(docs, model).collect()
    assert len(out) == len(corpus) and {r["record"]["bucket"] for r in out} == {7}
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["record"]["text"] or "")) for r in out)
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.fit(none)).collect()} == {"und"}
    assert language_id.identify(frame(spark, []), model).count() == 0


@pytest.mark.parametrize("held", [2_000_000, 300])
def test_every_labelled_row_counts(spark, monkeypatch, held):
    """Model and limits against counts of all labelled rows, however small the sample of ``fit`` would be."""
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 5)
    monkeypatch.setattr(language_id, "HELD_GRAMS", held)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0")
    docs = docs.unionByName(spark.createDataFrame([(10**6, "123 ...", "xx", "s", 7), (10**6 + 1, None, "fr", "s", 0)], docs.schema)).repartition(3)
    rows = [(r["text"].encode(), r["lang"]) for r in docs.where("lang is not null and text is not null").collect()]
    parts, totals = {}, {}
    for lang in {x for _, x in rows}:
        own = [language_id._prepare(t) for t, x in rows if x == lang]
        keys, n = np.unique(language_id._grams(own)[0], return_counts=True)
        parts[lang], totals[lang] = [(keys, n.astype(np.int64))], len(own)
    whole, model = language_id._model(parts, totals), language_id.fit_all(docs)
    assert model.languages == whole.languages == ["de", "en", "es", "fr", "xx"] and model.fallback == whole.fallback
    for a, b in zip(model.slices, whole.slices, strict=True):
        assert (a.bits == b.bits).all() and (a.false_positive == b.false_positive).all()

    scores = {}
    for (lang, score), (_, is_) in zip(whole.predict([t for t, _ in rows]), rows):
        if lang == is_:
            scores.setdefault(lang, []).append(int(score * language_id.SCORE_STEPS))
    expected = {x: language_id.LEAST_SHARE * sorted(v)[max(0, int(np.ceil(len(v) * language_id.LEAST_QUANTILE)) - 1)] / language_id.SCORE_STEPS for x, v in scores.items()}
    assert language_id.least_scores(docs, model) == expected


def test_the_pipeline_draws_no_sample(spark, monkeypatch):
    def drawn(*_):
        raise AssertionError("a sample was drawn")

    monkeypatch.setattr(language_id, "_drawn", drawn)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.language(spark, docs, SF).count() > 0.9 * docs.count()

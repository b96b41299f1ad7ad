"""The stages on a small corpus, each against brute force on its own input."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from conftest import frame, invented
from pyspark.sql import functions as F
from test_decontamination import brute as contaminated
from test_near_dedup import groups_of

import corpus_pipeline
from matrelate.llm import language_id


def near(rows, size, percent):
    """One row of each group: that of the smallest id, then digest; all rows without words."""
    out = []
    for group in groups_of(rows, size, percent):
        if group[0][1] and group[0][1].split():
            out.append(min(group, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())))
        else:
            out += group
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, corpus, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    quoted = dict(corpus)[1]
    frame(spark, [*corpus, (60, invented(1234, 30) + " " + " ".join(quoted.split()[4:16]))]).write.parquet(f"{d}/documents.parquet")
    items = [(1, " ".join(quoted.split()[2:20])), (2, "unseen words only here"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "near dedup", "decontamination", "tokens"]
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows(docs)
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        after = rows(out)
        if name == "language ID":
            gone = Counter(before) - Counter(after)
            assert {i for i, _ in gone} >= {23, 24, 25, 35} and 26 in dict(after) and not Counter(after) - Counter(before)
            assert {i for i, _ in gone} <= {23, 24, 25, 33, 34, 35}
        elif name == "exact dedup":
            first = {}
            for i, t in before:
                first[t] = min(x for x in (first.get(t), i) if x is not None) if (first.get(t), i) != (None, None) else None
            assert sorted(after, key=str) == sorted(((i, t) for t, i in first.items()), key=str)
        elif name == "near dedup":
            assert sorted(after, key=str) == sorted(near(before, 5, 80), key=str)
        else:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            hit = {i for i, _, n, _ in contaminated(before, items, 10) if n}
            assert {1, 60} <= hit and {i for i, _ in after} == {i for i, _ in before} - hit
        docs = out
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    final = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert final == {i: library.encode(t) for i, t in rows(docs)}


@pytest.mark.parametrize("unknown", ["de", "en", "es", "fr"])
def test_texts_of_no_known_language_go(spark, tmp_path, unknown):
    """With the labels of one language taken away, its texts go and all others stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text rlike '[a-z]'")
    known = F.when(F.col("lang") != unknown, F.col("lang"))
    docs = docs.withColumn("source", F.col("lang")).withColumn("lang", known)
    left = {r["source"]: r["count"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).groupBy("source").count().collect()}
    all_ = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    assert left.get(unknown, 0) <= 0.1 * all_[unknown]
    assert all(left[x] >= 0.995 * all_[x] for x in all_ if x != unknown)


def test_short_texts_are_not_judged_by_chance():
    """The slack shrinks with the number of n-grams, at every length."""
    assert language_id.SLACK / 4**0.5 >= 1 > language_id.SLACK / 400**0.5 + 0.5


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "token_ids"] and out.count() > 5


def test_empty_corpus(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def one_edit(text, at):
    w = text.split()
    w[at] = "edited"
    return " ".join(w)


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """Null and repeated ids: only judged rows go, and a group keeps one row."""
    a, b, c, d = (invented(9000 + k, 80) for k in range(4))
    rows = [(1, a), (None, one_edit(a, 40)), (None, "clean and null"), (7, one_edit(a, 20)), (7, "clean and seven")]
    rows += [(8, b), (8, one_edit(b, 40)), (8, one_edit(b, 20)), (None, c), (None, one_edit(c, 40))]
    rows += [(9, d), (9, d), (9, d + " "), (None, None), (None, None), (5, ""), (5, "")]
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, frame(spark, rows), str(tmp_path)).collect()]
    of = lambda text: [i for i, t in left if t and len(set(t.split()) & set(text.split())) > 60]
    assert (of(a), of(b), of(c), of(d)) == ([1], [8], [None], [9])
    clean = [(None, "clean and null"), (7, "clean and seven"), (None, None), (None, None), (5, ""), (5, "")]
    assert [r for r in rows if r in left and r in clean] == [r for r in rows if r in clean] and len(left) == 4 + len(clean)

    spark.createDataFrame([(1, " ".join(a.split()[5:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, a), (None, "clean and null"), (7, "so " + a), (7, "clean and seven"), (None, None), (6, a)]
    out = corpus_pipeline.decontaminate(spark, frame(spark, rows), str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(None, "clean and null"), (7, "clean and seven"), (None, None)], key=str)
    assert out.columns == frame(spark, []).columns

"""The registered queries themselves: against their SQL on the smallest tables, or against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pytest
import public_tokenizers
import sentencepiece
from test_lm_scoring import brute as scored

from matrelate.llm import importance, language_id, lm_scoring, queries, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def held_out(i, n):
    return zlib.crc32(str(i).encode()) % n == 2


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda x: sorted(map(tuple, x[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_sharding(spark, docs):
    rows = queries.op4_sharding(spark, SF).collect()
    text = {i: t or "" for i, t, _ in docs}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + sharding.RECORD_BYTES, zlib.crc32(raw), "rows", None)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1


def test_quality(spark, docs):
    """Weights by counting n-grams anew; the kept rows are those of the largest keys, as many as the share says."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0}
    share = sum(r["quality"] == 1 and r["toxic"] == 0 for r in labels) / len(labels)
    grams = {i: importance.features((t or "").encode()).tolist() for i, t, _ in docs}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in good:
            target.update(g)
    n_raw, n_target = sum(raw.values()) + importance.BUCKETS, sum(target.values()) + importance.BUCKETS
    weight = {i: sum(math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in g) for i, g in grams.items()}
    rows = queries.op6_quality(spark, SF).collect()
    assert all(abs(r["log_weight"] - weight[r["doc_id"]]) < 1e-6 * max(1, abs(weight[r["doc_id"]])) for r in rows)
    keys = sorted((r["key"] for r in rows), reverse=True)
    assert {r["doc_id"] for r in rows if r["kept"]} == {r["doc_id"] for r in rows if r["key"] >= keys[math.ceil(share * len(rows)) - 1]}
    # the noise is Gumbel's: the weight aside, it has no bearing on the text
    noise = [r["key"] - r["log_weight"] for r in rows]
    assert abs(sum(noise) / len(noise) - 0.5772) < 0.4


def exact_grams(text):
    """4-grams of bytes without a blank inside, in a text of letters only."""
    data = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode())
    data = b" " + data + b"   "
    return [data[k : k + 4] for k in range(len(data) - 3) if data[k + 1] != 32 and data[k + 2] != 32]


def test_language(spark, docs):
    """With exact sets in place of Bloom filters the same languages win, at nearly the same share."""
    counts = {}
    for i, t, lang in docs:
        if lang is not None and t is not None and not held_out(i, 4):
            counts.setdefault(lang, Counter()).update(exact_grams(t))
    total = {x: sum(c.values()) for x, c in counts.items()}
    share = {x: {g: n / total[x] for g, n in c.items()} for x, c in counts.items()}
    top = {}
    for s in share.values():
        for g, x in s.items():
            top[g] = max(top.get(g, 0), x)
    typical = {x: {g for g, v in s.items() if v >= language_id.TYPICAL * top[g] and counts[x][g] >= language_id.MIN_COUNT} for x, s in share.items()}
    text = {i: t for i, t, _ in docs}
    rows = queries.op7_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = text[r["doc_id"]]
        assert r["held_out"] == held_out(r["doc_id"], 4)
        if t is None or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        g = exact_grams(t)
        hits = sorted(((sum(x in typical[lang] for x in g) / max(len(g), 1), lang) for lang in typical), reverse=True)
        assert abs(r["score"] - hits[0][0]) < 0.02
        if hits[0][0] - hits[1][0] > 0.04:
            assert r["lang_pred"] == hits[0][1]


def test_pieces(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op9_pieces(spark, SF).collect()}
    want = {}
    for i, t, _ in docs:
        ids = library.encode(t or "")
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert rows == want


def test_scores(spark, docs):
    import test_lm_scoring

    keep = test_lm_scoring.training
    test_lm_scoring.training = queries._not_held_out
    try:
        want = scored([(i, t) for i, t, _ in docs], lm_scoring.PRIOR, lm_scoring.PRIOR3)
    finally:
        test_lm_scoring.training = keep
    got = {r["doc_id"]: r for r in queries.op10_lm_scoring(spark, SF).collect()}
    assert len(got) == len(want)
    for i, n, known, total, base, score in want:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out(i, 7), n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and abs(r["score"] - score) <= n / lm_scoring.STEPS + 1e-6

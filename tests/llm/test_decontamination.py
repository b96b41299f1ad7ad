import random
import re

import pytest
from conftest import frame, invented

from matrelate.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_near(rows, items, window, reach):
    out = []
    for doc_id, text in rows:
        w, ids = words(text), set()
        for i, t in items:
            q = words(t)
            for p in range(max(1, len(q) - window + 1) if q else 0):
                terms = set(q[p : p + window])
                if i is not None and any(terms <= set(w[a : a + reach]) for a in range(len(w))):
                    ids.add(str(i))
        out.append((doc_id, tuple(sorted(ids))))
    return sorted(out, key=str)


def brute(rows, items, window):
    windows = []
    for i, t in items:
        w = words(t)
        if w:
            windows += [(i, w[p : p + window]) for p in range(max(1, len(w) - window + 1))]
    out = []
    for doc_id, text in rows:
        w, hit, ids = words(text), set(), set()
        for i, win in windows:
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    ids.update([] if i is None else [str(i)])
        out.append((doc_id, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=str)


def run(spark, rows, items, **options):
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.search(decontamination.build_index(frame(spark, rows)), table, **options)
    return found.withColumn("n_hit", decontamination.n_hit()).collect()


def items_for(corpus):
    texts = dict(corpus)
    cut = lambda i, a, b: " ".join(texts[i].split()[a:b])
    return [
        (1, "Wholly new: " + cut(1, 5, 18).upper().replace("É", "é").replace("Ñ", "ñ") + "!"),
        (2, cut(1, 5, 17) + " tail"),
        (10, "one"),
        (11, "a, b; c"),
        (12, cut(4, 50, 60) + " " + cut(5, 0, 10)),  # runs over no document's end
        (13, ""),
        (14, None),
        (None, cut(2, 0, 20)),
        (15, cut(32, 19_000, 19_012)),
        (15, cut(32, 100, 112)),
        (16, "123"),
    ]


@pytest.mark.parametrize("part_bytes", [1 << 25, 100])
def test_against_brute_force(spark, corpus, monkeypatch, part_bytes):
    monkeypatch.setattr(decontamination, "PART_BYTES", part_bytes)
    items = items_for(corpus)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in run(spark, corpus, items, window=10)), key=str)
    assert got == brute(corpus, items, 10)
    assert any(x[3] for x in got)


def test_spans(spark):
    text = invented(1, 40)
    w = text.split()
    (row,) = run(spark, [(1, text)], [(1, " ".join(w[3:15])), (2, " ".join(w[10:22])), (3, " ".join(w[30:40]))], window=10)
    assert [(s["start"], s["end"]) for s in row["spans"]] == [(3, 22), (30, 40)]


def test_proximity(spark):
    rows = [(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "x " * 9 + "beta gamma"), (4, "alpha beta")]
    got = {r["doc_id"]: (r["item_ids"], r["near_item_ids"]) for r in run(spark, rows, [(7, "alpha beta gamma")], window=10, reach=5)}
    assert got == {1: ([], ["7"]), 2: ([], ["7"]), 3: ([], []), 4: ([], [])}


@pytest.mark.parametrize("reach", [1, 3, 10, 14])
def test_proximity_against_brute_force(spark, corpus, reach):
    r = random.Random(reach)
    rows = [(k, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))) for k in range(60)]
    items = [(k, " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12)))) for k in range(12)] + [(None, "a b")]
    shuffled = dict(corpus)[1].split()[5:17]
    rows += corpus + [(900, " ".join(sorted(shuffled)))]
    items += [(50, " ".join(shuffled)), *items_for(corpus)]
    got = sorted(((r["doc_id"], tuple(r["near_item_ids"])) for r in run(spark, rows, items, window=6, reach=reach)), key=str)
    assert got == brute_near(rows, items, 6, reach)
    assert any(x for _, x in got)


def test_parts_are_measured(spark, monkeypatch):
    """No part takes more than its bound, whatever the texts; all windows are in some part."""
    monkeypatch.setattr(decontamination, "PART_BYTES", 20_000)
    items = [(k, invented(k, 50)) for k in range(100)] + [(200, "a " * 900)]
    parts = list(decontamination._parts(spark.createDataFrame(items, "i string, t string"), 10))
    assert len(parts) > 2 and all(w.nbytes <= 20_000 for w in parts)
    assert sum(len(w.spread()[0]) for w in parts) == sum(max(1, len(t.split()) - 9) for _, t in items)


def test_items_without_an_id_hit_words(spark):
    (row,) = run(spark, [(1, "x a b c y")], [(None, "a b c"), (None, None)])
    assert (row["n_hit"], row["item_ids"]) == (3, [])


def test_empty_tables(spark, corpus):
    assert run(spark, [], [(1, "a b")]) == []
    assert all(r["n_hit"] == 0 for r in run(spark, corpus, []))

import random
import re

import numpy as np
import pytest
from conftest import frame, invented

from matrelate.llm import common, components, near_dedup
from matrelate.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[p : p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def groups_of(rows, size, percent):
    """Rows by connected component, found by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    out = {}
    for k, row in enumerate(rows):
        out.setdefault(root(k), []).append(row)
    return list(out.values())


def brute(rows, size, percent):
    out = []
    for group in groups_of(rows, size, percent):
        component = min((i for i, _ in group if i is not None), default=None)
        out += [(i, len(shingles(t, size)), component, i == component) for i, t in group]
    return sorted(out, key=str)


def run(spark, rows, size=4, percent=80):
    found = near_dedup.find_groups(frame(spark, rows), size, percent)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()), key=str)


def edited(words, seed, edits):
    r = random.Random(seed)
    w = list(words)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{seed}x{r.randrange(10**6)}"
    return " ".join(w)


def test_corpus(spark, corpus):
    assert run(spark, corpus) == brute(corpus, 4, 80)


@pytest.mark.parametrize("block_hashes", [100_000, 700])
def test_large_loose_group(spark, monkeypatch, block_hashes):
    """Variants of variants around the threshold: stars alone would miss links."""
    monkeypatch.setattr(near_dedup, "BLOCK_HASHES", block_hashes)
    words = invented(3, 120).split()
    rows = [(1000 + k, edited(words, k, 1 + k % 6)) for k in range(70)]
    rows += [(3000 + k, edited(rows[k][1].split(), 500 + k, 3)) for k in range(50)]
    assert run(spark, rows) == brute(rows, 4, 80)


def test_short_texts(spark):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice("abcde") for _ in range(r.randint(0, 12)))) for k in range(150)]
    assert run(spark, rows) == brute(rows, 4, 80)
    assert run(spark, rows, size=5) == brute(rows, 5, 80)


def test_many_copies(spark):
    text = invented(5, 50)
    rows = [(k, text) for k in range(300)] + [(500, edited(text.split(), 1, 1)), (501, invented(6, 50))]
    assert run(spark, rows) == brute(rows, 4, 80)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, ""), (3, " ")]) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        agree = []
        for _ in range(60):
            base = r.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2)
            k = int(400 * share)
            a = np.unique(base)
            b = np.unique(np.concatenate([base[:k], r.integers(0, 2**63, 400 - k).astype(np.uint64) * np.uint64(2)]))
            s = near_dedup.signatures([a, b])
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - k / (800 - k)) < 0.03


@pytest.mark.parametrize("task_links, nodes", [(200_000, 400_000), (20, 400_000), (20, 5)])
def test_components(spark, monkeypatch, task_links, nodes):
    monkeypatch.setattr(components, "TASK_LINKS", task_links)
    monkeypatch.setattr(components, "FOREST_NODES", nodes)
    r = random.Random(7)
    links = [(k, k + 1) for k in range(0, 60)] + [(200 + r.randrange(40), 200 + r.randrange(40)) for _ in range(30)] + [(500, k) for k in range(501, 560)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    loops = {a for a, b in links if a == b}
    assert got == {x: root(x) for x in parent if x in got} and set(parent) - set(got) <= loops
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bound", [None, 0])
def test_the_driver_holds_no_hash_tables_but_counted_ones(spark, monkeypatch, bound):
    """Under a session that broadcasts freely: the wanted ids as one long each if they are few, nothing else."""
    plans = []

    def watched(df, *args, **kinds):
        plans.append(df.select("*")._jdf.queryExecution().executedPlan().toString())
        return common.materialize(df, *args, **kinds)

    monkeypatch.setattr(near_dedup, "materialize", watched)
    monkeypatch.setattr(components, "materialize", watched)
    if bound is not None:
        monkeypatch.setattr(near_dedup, "small", lambda ids: common.small(ids, bound))
    base = [invented(k, 60) for k in range(8)]
    rows = [*enumerate(base), *[(20 + k, edited(t.split(), k, 1)) for k, t in enumerate(base)], (None, base[3] + " more"), (None, base[5] + " words")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found = near_dedup.find_groups(frame(spark, rows), 4, 80)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()), key=str)
    assert got == brute(rows, 4, 80)
    tables = [line for p in plans for line in p.splitlines() if "BroadcastExchange" in line]
    assert len(tables) == (0 if bound == 0 else 1) and all("input[0, bigint, false]" in x for x in tables)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_many_keys_are_not_broadcast(spark):
    """Rows beyond the bound go by a shuffle, whatever the session's threshold; none is lost."""
    rows, gone = spark.range(300_000), spark.range(common.BROADCAST_KEYS + 1)
    for bound, tables in ((gone, 0), (spark.range(100), 1)):
        left = common.without(rows, bound, ["id"])
        assert left._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == tables
        assert left.count() == 300_000 - bound.count()
    assert common.BROADCAST_KEYS * 200 <= 40 << 20

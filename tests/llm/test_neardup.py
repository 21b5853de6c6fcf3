import random

import numpy as np
import pytest

from cloakspark.llm import neardup
from cloakspark.llm.common import lowered, mix


def sets_of(text, k):
    w = lowered(text).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = [(i, sets_of(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def same(spark, rows, k):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, comp string")
    got = neardup.near_duplicates(df, k=k).collect()
    want = brute(rows, k)
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None) == sorted((i, len(sets_of(t, k))) for i, t in rows if i is not None)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] == want.get(r["doc_id"]))


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "Ö", "a"]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 5, 30, 200]))] for _ in range(40)]
    rows = []
    for i in range(260):
        w = list(rng.choice(base[:6] if i % 3 == 0 else base))
        for _ in range(rng.choice([0, 0, 1, 3, len(w) // 12])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((1000 - i, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    same(spark, corpus() + [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (5, "one"), (6, "x y"), (6, "p q"), (7, "P q")], k)


def test_hot_buckets_in_small_cells(spark, monkeypatch):
    for name, value in {"HOT_SAMPLE": 1, "HOT_LEAST": 6, "HOT_SHARE": 0, "CELL_DOCS": 3, "CELL_ELEMENTS": 500, "KEYS_AT_ONCE": 512, "BLOCK": 8}.items():
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(9)
    shared, rows = [f"s{i}" for i in range(60)], []
    for i in range(90):  # halves in common, and copies of one with an edit each
        rows.append((500 + i, " ".join(shared + [f"own{i}.{j}" for j in range(rng.choice([10, 14, 60]))])))
        rows.append((700 + i, " ".join([f"c{j}" if j != i else f"edit{i}" for j in range(90)])))
    same(spark, rows, 2)


def test_packed_entries_survive():
    rng = np.random.default_rng(4)
    for kind in (np.uint64, np.int64):
        x = rng.integers(0, 1 << 62, 1000).astype(kind)
        assert (neardup._unplanes(neardup._planes(x), kind) == x).all()


def test_very_long_text(spark):
    base = [f"w{i}" for i in range(120_000)]
    other = [w if i % 40 else f"x{i}" for i, w in enumerate(base)]
    same(spark, [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:60_000])), (4, "the " * 300_000), (5, "The " * 299_000)], 2)


def test_empty_table_and_null_ids(spark):
    same(spark, [], 2)
    got = neardup.near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string"), k=2).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, None, True), (1, 1, True)}


def test_one_of_each_group_stays(spark):
    rows = corpus(8)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, doc int")
    out = neardup.deduplicate(df, k=5)
    assert out.columns == df.columns
    want = brute(rows, 5)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, c in want.items() if i == c)


def test_superminhash_estimates_jaccard_with_less_variance():
    rng = np.random.default_rng(0)
    errors = []
    for trial in range(200):
        x = mix(rng.integers(0, 1 << 62, 150).astype(np.uint64))
        a, b = neardup.superminhash([x[:100], x[25:125]])
        errors.append((a == b).mean() - 75 / 125)
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.6 * 0.4 / neardup.SLOTS


def test_signature_slots_come_from_permutations():
    """With one element every slot holds its own rank: the ranks are a permutation."""
    sig = neardup.superminhash([np.array([12345], dtype=np.uint64)])[0]
    assert sorted(sig >> 40) == list(range(neardup.SLOTS))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["comp"] for r in neardup.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}

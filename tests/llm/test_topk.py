import math
import random

from cloakspark.llm import topk


def brute(rows, k=20, every=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (qi, q) in enumerate(good):
        if qi % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for m, (i, v) in enumerate(good) if m != n and len(v) == len(q) and q)[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def same(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, v int, row int")
    assert sorted(map(tuple, topk.top_k(df, **kw).collect())) == brute(rows, **kw)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1), 0.5]) for _ in range(6)]) for i in range(0, 200)]
    rows += [(20, rows[20][1]), (40, rows[3][1]), (None, rows[0][1]), (60, None), (80, [float("nan")] * 6), (100, [None] * 6), (7, [float("inf")] * 6), (120, []), (140, [1.0, 2.0])]
    same(spark, rows)


def test_large_values_few_rows_and_none(spark):
    same(spark, [(0, [1e7, -1e7]), (1, [1e7, 3.0]), (2, [0.0, 0.0])])
    same(spark, [(0, [1.0])])
    same(spark, [])

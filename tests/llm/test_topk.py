import math

import numpy as np
import pytest
from tabloom.llm import topk

SF = "/root/testdata/sf0.001"


def brute(rows, every=50, k=5):
    own = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v):
            own.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for q in sorted({i for i, _ in own if i % every == 0}):
        qv = min(v for i, v in own if i == q)
        found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in own if i != q and len(v) == len(qv))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return out


def run(df, **how):
    return sorted(map(tuple, topk.exact_top_k(df, df.where("vec_id % 50 = 0"), **how).collect()))


@pytest.mark.parametrize("how", [{}, {"shard_rows": 37, "block_rows": 3}, {"seed_rows": 40, "shard_rows": 16, "block_rows": 1}])
def test_against_brute_force(spark, how):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert run(df, **how) == brute([(r[0], r[1]) for r in df.collect()])


def test_ties_and_odd_rows(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.integers(-1, 2, 3)]) for i in range(400)] + [(i, [1.0, 1.0, 1.0]) for i in range(400, 700)]
    rows += [(50, [1.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0]), (7, None), (None, [1.0, 2.0, 3.0]), (100, [None, 1.0, 1.0]), (150, [float("nan")] * 3), (200, [float("inf"), 0.0, 0.0]), (1000, [1.0]), (1001, [2.0]), (1050, []), (1051, []), (1100, [1e300, -1e300]), (1101, [1e300, 1e300]), (1150, [5.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    assert run(df, shard_rows=64) == [(q, k, i, cut(s)) for q, k, i, s in brute(rows)]
    assert run(df, shard_rows=64, seed_rows=50) == run(df)
    assert run(df.limit(0)) == []


def test_tree():
    r = np.random.default_rng(1)
    rows = r.integers(-50, 50, (500, 4)).astype(float)
    tree = topk.KDTree(np.arange(500), rows, leaf=8)
    q = r.integers(-50, 50, (9, 4)).astype(float)
    for x, b in zip(q, tree.bounds(q)):
        assert b[0] >= (rows @ x).max()
        best = []
        tree.search(x, -1, b.tolist(), best, 3)
        assert sorted(best, reverse=True) == sorted(zip((rows @ x).tolist(), range(0, -500, -1)), reverse=True)[:3]

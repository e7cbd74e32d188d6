import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tabloom.llm import ngram_lm as L, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(docs, order):
    """The model by its definition, with dictionaries."""
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    learnt = [words(t) for i, t in docs if not out[i]]
    c = collections.Counter(w for t in learnt for w in t)
    n, v = sum(c.values()), len(c)
    counts = {order: collections.Counter(tuple((["<s>"] * (order - 1) + t)[j : j + order]) for t in learnt for j in range(len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    cut = {k: L.discounts(*[sum(x == m for x in counts[k].values()) for m in (1, 2, 3, 4)]) for k in counts}
    ahead = {k: collections.defaultdict(lambda: [0, 0, 0, 0]) for k in counts}
    for k in counts:
        for g, m in counts[k].items():
            ahead[k][g[:-1]][0] += m
            ahead[k][g[:-1]][min(m, 3)] += 1

    def p(g):
        if not g:
            return 1 / (v + 1)
        e = ahead[len(g)].get(g[:-1])
        if e is None:
            return p(g[1:])
        m = counts[len(g)].get(g, 0)
        return (m - (cut[len(g)][min(m, 3) - 1] if m else 0)) / e[0] + sum(a * b for a, b in zip(cut[len(g)], e[1:])) / e[0] * p(g[1:])

    rows = []
    for i, t in docs:
        w = words(t)
        full = ["<s>"] * (order - 1) + w
        rows.append((i, out[i], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(tuple(full[j : j + order]))) for j in range(len(w)))))
    return rows


def same(got, want):
    key = lambda r: (repr(r[:5]), r[5], r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(a[:5]) == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, order):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same(L.lm_scores(df, order).collect(), brute([(r.doc_id, r.text) for r in df.collect()], order))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "a B a"), (3, "a b"), (3, "a b"), (5, "Ä ä\x0bx\x00 \x1f y"), (6, "w " * 5000), (7, "  lead"), (8, "trail \n"), (9, "x" * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 held_out", "2 score")
    same(L.lm_scores(df, 2).collect(), brute(docs, 2))
    assert L.lm_scores(df.limit(0)).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = L.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert tuple(got[0]) == (held, True, 3, 0, 0, 0.0, 0.0)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([("a b c a b",), ("b c c",), ("a a b d",)], "text string").selectExpr("cast(text as binary) text")
    m = L.train(df, 2)
    w, per = L.tokens(pa.array([b"a b c d unseen"], pa.binary()))
    for back in [b"", b"a", b"b", b"zzz"]:
        before = L.contexts(*L.tokens(pa.array([back + b" x"], pa.binary())), 2)[1][len(back.split())]
        _, p = m.score(w, [np.zeros(len(w), np.uint64), np.full(len(w), before)])
        assert (10**p).sum() == pytest.approx(1, abs=1e-9)


def test_held_out_gain(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = L.lm_scores(df).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert own["s"] > own["b"]


def test_query_is_of_order_three(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same(queries.op9_lm(spark, "/root/testdata/sf0.001").collect(), brute([(r.doc_id, r.text) for r in df.collect()], 3))


def test_rows_are_counted_dealt_and_found():
    """Against plain versions: counts without sums beside them, ranges' own dictionaries, searches in buckets of any size."""
    r = np.random.default_rng(2)
    for kinds, n in ((1, 5), (50, 3000), (1 << 22, 3000), (7, 0)):
        ids = [np.minimum(r.zipf(1.3, n) - 1, kinds - 1).astype(np.uint32) for _ in range(3)]
        want = collections.Counter(zip(*[x.tolist() for x in ids], strict=True))
        for sums in ([], [np.ones(n, np.uint64)]):
            own, counts, summed = L._merged(ids, kinds, sums)
            assert list(zip(*[x.tolist() for x in own], strict=True)) == sorted(want) and counts.tolist() == [want[k] for k in sorted(want)]
            assert all(s.tolist() == counts.tolist() for s in summed)
    hashes = np.unique(r.integers(0, 1 << 48, 50, np.uint64))
    ids = [r.integers(0, len(hashes), 400).astype(np.uint32) for _ in range(2)]
    n = r.integers(1, 9, 400).astype(np.uint64)
    for shards in (1, 7, 70_000):
        got = []
        for s, blob in L._dealt(hashes, ids, n, n, shards):
            words, a, b, m, _ = L._unpack(blob, True)
            words = np.cumsum(words, dtype=np.uint64)
            assert (np.diff(words.astype(np.int64)) > 0).all() and set(range(len(words))) == {*a.tolist(), *b.tolist()}
            assert (L._context([words[a], words[b]]) % np.uint64(shards) == s).all()
            got += zip(words[a].tolist(), words[b].tolist(), m.tolist(), strict=True)
        assert sorted(got) == sorted(zip(*[hashes[x].tolist() for x in ids], n.tolist(), strict=True))
    for size in (0, 1, 2, 33, 5000):
        keys = np.unique(np.r_[r.integers(0, 1 << 63, size, np.uint64) << np.uint64(1), np.arange(size // 4, dtype=np.uint64) << np.uint64(40)])
        starts, low, order = L._indexed(keys)
        asked = np.r_[keys, keys ^ np.uint64(1 << 50), np.array([0, (1 << 64) - 1], np.uint64)]
        there, at = L._looked_up(starts, L._least_type(low), asked)
        assert there.tolist() == np.isin(asked, keys).tolist() and (keys[order][at[there]] == asked[there]).all()

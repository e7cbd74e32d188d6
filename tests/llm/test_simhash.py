import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tabloom.llm import simhash
from tabloom.llm.bktree import BKTree, Forest
from tabloom.llm.components import components

DATA = "/root/testdata/sf0.001/documents.parquet"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("radius", [0, 2, 9])
def test_tree_finds_all_pairs(radius):
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, 60, np.uint64)
    keys = np.concatenate([keys, keys ^ np.uint64(5), keys[:20], keys ^ (np.uint64(1) << r.integers(0, 63, 60).astype(np.uint64))])
    got = {(int(a), int(b)) for q, k in BKTree(keys).within(keys, radius, block=37) for a, b in zip(q, k)}
    assert got == {(i, j) for i in range(len(keys)) for j in range(len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= radius}


def test_tree_of_nothing():
    assert list(BKTree(np.empty(0, np.uint64)).within(np.zeros(1, np.uint64), 2)) == []


def test_forest():
    a, b = Forest(6), Forest(6)
    a.join_all(np.array([5, 3, 1]), np.array([3, 1, 4]))
    for i, j in ((5, 3), (3, 1), (1, 4)):
        b.join(i, j)
    assert a.flatten().tolist() == b.flatten().tolist() == [0, 1, 2, 1, 1, 1]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (41, 3), (41, 3)]
    got = dict(rows(components(spark.createDataFrame(pairs, "u long, v long"), "t")))
    assert got == {**dict.fromkeys(range(42), 0), **dict.fromkeys(range(100, 150), 100)}
    assert rows(components(spark.createDataFrame([], "u long, v long"), "t")) == []


def test_links_of_crowded_blocks(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 12, np.uint64)
    fps = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in r.integers(0, 64, (25, 2))} | {int(b) for b in base}
    signed = sorted(f - (1 << 64) * (f >> 63) for f in fps)
    bits = [f & (1 << 64) - 1 for f in signed]
    root = brute.components(len(bits), [(i, j) for i in range(len(bits)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 2])
    want = {(signed[i], signed[x]) for i, x in enumerate(root) if root.count(x) > 1}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for hot, shard in ((5, 50), (10_000, 64), (0, 1)):
        assert set(rows(simhash.link_fingerprints(df, 2, shard, hot))) == want


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(DATA)
    plain = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows(simhash.simhash_components(docs)) == sorted(brute.simhash_rows(plain), key=repr)


def test_odd_rows(spark):
    docs = [(3, None), (1, ""), (2, " \t\n"), (None, "a b c d"), (9, "a B c d"), (9, "a b c d"), (4, "one"), (5, "ONE"), (6, "Äpfel äpfel  x y"), (7, "w " * 70000)]
    assert rows(simhash.simhash_components(frame(spark, docs))) == sorted(brute.simhash_rows(docs), key=repr)
    assert rows(simhash.simhash_components(frame(spark, []))) == []
    assert rows(simhash.simhash_components(frame(spark, [(None, "x"), (None, "x")])))[0][2] is None


def test_clashing_columns(spark):
    df = frame(spark, [(1, "a b c")]).selectExpr("doc_id", "text", "1 fp", "2 root", "3 least", "4 node")
    assert rows(simhash.simhash_components(df)) == brute.simhash_rows([(1, "a b c")])


def near_docs():
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(12):
        base = r.choice(words, 60 + 20 * g).tolist()
        docs.append(" ".join(base))
        for k in range(8):
            own = list(base)
            for _ in range(1 + k // 2):
                own[r.integers(len(own))] = f"x{r.integers(10**6)}"
            docs.append(" ".join(own))
    return [(i, t) for i, t in enumerate([*docs, *docs[:5], "", None, "one two", "ONE  two"])]


@pytest.mark.parametrize("limits", [{}, {"block_rows": 3}, {"shard_rows": 4}])
def test_near_groups(spark, limits):
    docs = near_docs()
    df = frame(spark, docs)
    assert rows(simhash.near_groups(df, **limits).drop("raw")) == sorted(brute.near_rows(docs), key=repr)
    if not limits:
        lost = {i for i, g in brute.near_rows(docs) if i != g}
        assert rows(simhash.one_of_each(df)) == sorted([d for d in docs if d[0] not in lost], key=repr)


def test_near_groups_of_distant_fingerprints(spark):
    r, docs, far = np.random.default_rng(11), [], 0
    for g in range(200):
        words = [f"w{i}" for i in r.integers(0, 10**6, 9)]
        a, b = " ".join(words[:8]), " ".join(words)
        far += (brute.simhash(a, 5) ^ brute.simhash(b, 5)).bit_count() > 18
        docs += [(2 * g, a), (2 * g + 1, b)]
    assert far
    assert rows(simhash.near_groups(frame(spark, docs)).drop("raw")) == sorted(brute.near_rows(docs), key=repr)


def test_near_groups_by_fingerprints_alone(spark):
    """One band of 1,500 minimum hashes brings none of these pairs together; links of fingerprints and trees do."""
    r, docs = np.random.default_rng(13), []
    for g in range(12):
        words = [f"w{i}" for i in r.integers(0, 10**6, 600)]
        docs += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words[:-1], "other"]))]
    apart = [(brute.simhash(a[1], 5) ^ brute.simhash(b[1], 5)).bit_count() for a, b in zip(docs[::2], docs[1::2])]
    docs = [d for d in docs if apart[d[0] // 2] <= 2]
    assert len(docs) >= 16
    assert rows(simhash.near_groups(frame(spark, docs), bands=1, rows=1500).drop("raw")) == sorted(brute.near_rows(docs), key=repr)
    words = [f"w{i}" for i in r.integers(0, 10**6, 40)]
    few = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, " ".join(["y", *words[1:]]))]
    node = np.arange(3)
    table = [(0, 0, 0, 0, int(n), brute.simhash(t, 5) - (1 << 64) * (brute.simhash(t, 5) >> 63), [int(n)], t) for n, (_, t) in zip(node, few)]
    dealt = spark.createDataFrame(table, "part int, p int, q int, block int, node long, fp long, bands array<long>, text string").withColumn("text", F.col("text").cast("binary"))
    assert len(simhash._verified(dealt, 5, 0.8, 64).collect()) == 2 and simhash._verified(dealt, 5, 0.8, 0).collect() == []

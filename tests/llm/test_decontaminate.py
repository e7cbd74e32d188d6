import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tabloom.llm import decontaminate as d

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def run(spark, docs, bench, **more):
    docs = spark.createDataFrame(docs, "doc_id long, text string, hits string, items string")
    return rows(d.digest(d.contamination(docs, spark.createDataFrame(bench, "item_id long, text string"), **more)))


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(0, 3), max_size=14), max_size=4))
def test_hits(doc, bench):
    text = " ".join(map(str, doc))
    named = [(i, " ".join(map(str, b))) for i, b in enumerate(bench)]
    items = d.Items([(str(i), t.encode()) for i, t in named], 8, 5)
    hit, found = items.hits(np.array([items.vocabulary.get(w, -1) for w in d.words_of(text.encode())], np.int64))
    want = brute.contamination_rows([(0, text)], named)[0]
    assert (int(hit.sum()), len(found)) == want[2:4]


def test_query_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.contamination_rows([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()])
    assert rows(d.digest(d.contamination(docs, bench))) == sorted(want, key=repr)
    assert rows(d.digest(d.contamination(docs, bench, block_bytes=500))) == sorted(want, key=repr)
    assert any(r[3] for r in want)


def test_rows_that_stay(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    n_items = {r.doc_id: r.n_items for r in d.digest(d.contamination(docs, bench)).collect()}
    for least in (1, 2):
        want = sorted(i for i, n in n_items.items() if n < least)
        assert len(want) < len(n_items) or least > 1
        for more in ({}, {"block_bytes": 500}):
            got = d.decontaminated(docs, bench, least, **more)
            assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want


def test_odd_rows(spark):
    bench = [(10, "a b c d e f g h i"), (9, "a b c d e f g h i"), (1, "Über 5"), (2, ""), (3, None), (None, "b-c-d"), (4, "q")]
    docs = [(1, None), (None, "x a b c d e f g h y"), (2, ""), (3, "über\x0b5 über, q"), (3, "b c d q" * 9000), (5, "A.B.C.D.E.F.G.H.I")]
    more = [(i, t, "h", "i") for i, t in docs]
    want = brute.contamination_rows(docs, [(i, t) for i, t in bench if i is not None] + [("", "b-c-d")])
    got = run(spark, more, bench)
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want, key=repr)]
    assert run(spark, more, bench, block_bytes=1) == got and run(spark, [], bench, block_bytes=1) == []
    assert run(spark, [], bench) == []
    assert run(spark, more[:2], []) == [(1, 0, 0, 0, d.sha256_of([]), False), (None, 10, 0, 0, d.sha256_of([]), False)]
    with pytest.raises(ValueError):
        run(spark, more, bench, k=9)

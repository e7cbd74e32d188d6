import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tabloom.llm import quality as Q

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_features(text):
    """Shares of characters, and counts of hashed words and pairs, by their definition."""
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), data)) if w]
    hashed = [int(Q.tokens(pa.array([w], pa.binary()))[0][0]) for w in words]
    counts = Counter(h % Q.WORDS for h in hashed)
    for a, b in zip(hashed, hashed[1:]):
        counts[Q.WORDS + int(Q._mixed(np.array([a], np.uint64) * Q.MIX ^ np.array([b], np.uint64))[0]) % Q.PAIRS] += 1
    n = max(1, len(words))
    dense = [f * sum(c in chars for c in data) / max(1, len(data)) for chars, f in Q.KINDS]
    return dense + [sum(a == b for a, b in zip(words, words[1:])) / n, len(data) / n / 6, np.log1p(len(words)) / 5], counts


def test_features(spark):
    texts = [None, "", "A b a b b!", "x | 12\n\ny.", "wort Wort wort", "ä" * 300, "w " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in Q.features(df).collect():
        dense, counts = plain_features(texts[r.doc_id])
        assert r.t == pytest.approx(dense, rel=1e-5, abs=1e-6) and dict(zip(r.b, r.c)) == counts


def plain_co_training(rows, labels, most, rounds, give, sure):
    """The exchange over all unlabelled rows at once, in one place. rows: id -> (text view, metadata view)."""
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    ids = sorted((i for i in labels if not out(i) and i in rows), key=lambda i: (Q._order(i), i))
    assert len(ids) <= most
    state = Q.CoTraining([np.stack([rows[i][v] for i in ids]) for v in (0, 1)], np.array([float(labels[i]) for i in ids]))
    free, given = [i for i in rows if i not in labels and not out(i)], set()
    for _ in range(rounds):
        found = []
        for v in (0, 1):
            z = {i: float(Q._value(state.weights[v], rows[i][v].astype(np.float64))) for i in free if (v, i) not in given}
            for y in (0, 1):
                p = {i: 1 / (1 + np.exp(-np.clip(x if y else -x, -30, 30))) for i, x in z.items()}
                best = sorted((i for i in p if p[i] >= sure), key=lambda i: (-round(p[i], 9), Q._order(i), i))[:give]
                found += [(v, y, i) for i in best]
        for v, y, i in found:
            given.add((v, i))
            state.more[1 - v].append((rows[i][1 - v], float(y)))
        state.refit()
    return state.combined(), given


def test_against_plain_co_training(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    table = Q.stored(Q.features(docs), "test-features")
    rows = Q._fetched(table, [r.doc_id for r in docs.select("doc_id").collect()])
    how = dict(most=2000, rounds=2, give=20, sure=0.9)
    (views, joint), given = plain_co_training(rows, {r.doc_id: r.quality for r in marks.collect()}, **how)
    got_views, got_joint = Q.train(table, marks, **how)
    assert len(given) > 40
    for a, b in zip([*views, joint], [*got_views, got_joint]):
        assert np.allclose(a, b, atol=2e-2)
    scores = {r.doc_id: r.score for r in Q.quality_scores(table, (got_views, got_joint)).collect()}
    for i, (text, meta) in rows.items():
        z = joint[0] * Q._value(views[0], text) + joint[1] * Q._value(views[1], meta) + joint[2]
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=2e-2)


def test_held_out_accuracy(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.quality(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    for column, least in (("score", 0.97), ("text_score", 0.95)):
        assert np.mean([(r[column] >= 0.5) == bool(r["quality"]) for r in rows]) >= least


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "de", "t", 0), (2, "", "de", "t", 0), (3, "x " * 100_000, None, "s", None)]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 id", "2 y", "3 label", "4 t", "5 m", "6 score", "7 b")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.quality(df, none).collect()
    assert len(got) == 5 and all(r["score"] is None and r["predicted"] == 1 for r in got)
    marks = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (None, 1), (2, 7)], "doc_id long, quality int")
    assert len(Q.quality(df, marks).collect()) == 5
    assert Q.quality(df.limit(0), marks).collect() == []
    assert len(Q.quality(df.select("doc_id", "text"), marks).collect()) == 5

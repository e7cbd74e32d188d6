import zlib

import numpy as np
import pytest
from tabloom.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_windows():
    for n in (0, 1, 16, 31, 32, 33, 48, 49, 100):
        w, length = T.windows_of(np.arange(n))
        assert set(w[w >= 0].tolist()) == set(range(n))
        assert (length == (w >= 0).sum(1)).all() and (n == 0) == (len(w) == 0)


def test_gradients():
    words = [b"a", b"bc", b"word", b"zz"]
    net = T.Network({b"a": 1, b"bc": 2}, 1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    at = np.full((3, T.WINDOW), -1)
    at[0, :5], at[1, :2], at[2] = [0, 1, 2, 3, 0], [2, 2], np.arange(T.WINDOW) % 4
    length, y = np.array([5, 2, 32]), np.array([1.0, 0, 1])
    grams = T._flat_grams(words)

    def loss():
        z = net.logits(net.projected(net.inputs(net.rows(words), *grams).astype(np.float64)), at, length)
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    g = net.gradients(net.rows(words), *grams, at, length, y)
    for k in net.p:
        i = np.unravel_index(np.argmax(abs(g[k])), g[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up = loss()
        net.p[k][i] = old - 1e-3
        assert (up - loss()) / 2e-3 == pytest.approx(float(g[k][i]), rel=2e-2, abs=1e-5)
        net.p[k][i] = old


@pytest.fixture(scope="module")
def sample():
    r = np.random.default_rng(2)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = r.choice(plain, r.integers(5, 200)).tolist()
        if i % 4 == 0:
            for _ in range(3):
                text[r.integers(len(text))] = str(r.choice(["idiotic", "scumbag", "moronish"]))
        rows.append((" ".join(text), int(i % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def model(sample):
    return T.fit([(t.encode(), y) for t, y in sample[:300]], steps=150)


def test_held_out_accuracy(model, sample):
    s = T.Scorer(model)([t.encode() for t, _ in sample[300:]])
    y = np.array([y for _, y in sample[300:]])
    assert ((s >= 0.7) == y).mean() >= 0.95


def test_scores_do_not_depend_on_company(model, sample):
    texts = [t.encode() for t, _ in sample[:40]] + [b"", b" .,! ", b"plain w1 " * 70_000 + b"scumbag scumbag scumbag"]
    together, alone = T.Scorer(model)(texts), [float(T.Scorer(model)([t])[0]) for t in texts]
    assert np.allclose(together, alone, atol=1e-5) and together[-2] == together[-3] == 0


def test_rows(spark, model):
    docs = [(1, None), (None, "w1 idiotic w2 scumbag scumbag"), (2, ""), (2, "IDIOTIC!!! *scumbag* moronish"), (3, "w1 w2")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 score", "2 lang")
    got = {(r["doc_id"], r["predicted"]) for r in T.toxicity(df, model).collect()}
    assert got >= {(1, 0), (None, 1), (2, 0), (2, 1), (3, 0)}
    assert sorted(map(repr, T.without_toxic(df, model).select("doc_id", "text").collect())) == sorted(map(repr, df.select("doc_id", "text").where("doc_id = 1 or text = '' or doc_id = 3").collect()))
    assert T.toxicity(df.limit(0), model).collect() == []
    assert {r["score"] for r in T.toxicity(df, T.Constant(0.0)).collect()} == {0.0}


def test_labels(spark):
    docs = spark.createDataFrame([(i, f"t{i} x") for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.train(docs, none).share == 0.0
    odd = spark.createDataFrame([(None, 1), (3, None), (4, 7), (5, 0), (6, 0)], "doc_id long, toxic int")
    assert T.train(docs, odd).share == 0.0


def naive(model, text):
    """The network over all windows of a text, word by word and cell by cell."""
    p, c = model.p, T.CELLS
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    words, best = T.words_of(text), -np.inf
    vector = {}
    for w in set(words):
        grams = T._grams_of(w)
        vector[w] = np.r_[p["word"][model.vocabulary.get(w, 0)], sum(p["gram"][g] for g in grams) / np.sqrt(len(grams))].astype(np.float64)
    for at in range(0, max(1, len(words) - T.WINDOW + T.STRIDE), T.STRIDE):
        own, states = [vector[w] for w in words[at : at + T.WINDOW]], []
        for d, xs in (("f", own), ("b", own[::-1])):
            h, out = np.zeros(c), []
            for x in xs:
                i, g = x @ p[f"w{d}"] + p[f"b{d}"], h @ p[f"u{d}"]
                z, r = sigmoid(i[:c] + g[:c]), sigmoid(i[c : 2 * c] + g[c : 2 * c])
                h = z * h + (1 - z) * np.tanh(i[2 * c :] + r * g[2 * c :])
                out.append(h)
            states.append(out if d == "f" else out[::-1])
        if own:
            h = np.concatenate(states, 1)
            a = np.exp(h @ p["att"])
            best = max(best, float((a / a.sum()) @ h @ p["out"] + p["bias"][0]))
    return best


def labelled(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = T.train(docs, labels)
    rows = T.toxicity(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    return model, rows


def test_small_table(spark):
    """Fitted on a few dozen toxic texts, and against the plain network over all windows."""
    model, rows = labelled(spark, "sf0.01")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    for r in sorted(rows, key=lambda r: r["doc_id"])[:60]:
        assert float(model.probability(np.array([naive(model, (r["text"] or "").encode())]))[0]) == pytest.approx(r["score"], abs=1e-4)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == r["toxic"] for r in held)
    caught = sum(r["predicted"] for r in held if r["toxic"])
    assert right > sum(1 - r["toxic"] for r in held) and caught >= 5 and sum(r["predicted"] for r in held if not r["toxic"]) <= 2


def test_larger_table(spark):
    _, rows = labelled(spark, "sf0.1")
    held = [r for r in rows if r["held_out"]]
    toxic = [r["predicted"] for r in held if r["toxic"]]
    clean = [r["predicted"] for r in held if not r["toxic"]]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.02 * len(clean)

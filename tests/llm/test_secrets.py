import base64
import hashlib
import re
import time

import pytest
from tabloom.llm import secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
DATA = "/root/testdata/sf0.001/documents.parquet"


def brute(doc, text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return doc, *(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(names.encode()).hexdigest()


def llr(ratios, word):
    at = secrets.ALPHABET.index
    return sum(ratios[at(a) * len(secrets.ALPHABET) + at(b)] for a, b in zip(word, word[1:]))


def markov(text, ratios, least=20, threshold=15_000):
    """Spans of the model by its definition: base matches blanked, then each run as a whole or by its parts."""
    blank = lambda p, ok, t: re.sub(p, lambda m: " " * len(m[0]) if ok(m) else m[0], t)
    t = blank(ASSIGN, lambda m: len(m[2]) >= 6, text or "")
    t = blank(re.compile("[0-9a-f]{24,}"), lambda m: True, blank(re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20, t))
    at, size, out = secrets.ALPHABET.index, len(secrets.ALPHABET), []
    varied = lambda s: len(set(s)) >= min(len(s) // 2, secrets.VARIED)
    for m in re.finditer("[A-Za-z0-9+/_=-]{%d,}" % least, t):
        run, lo = m[0], m.start()
        steps = [at(a) * size + at(b) for a, b in zip(run, run[1:])]
        values = [ratios[p] for p in steps]
        if sum(values) >= threshold and varied(steps):
            out.append((lo, lo + len(run)))
            continue
        parts, total, start, best, end = [], 0, 0, 0, 0
        for i, v in enumerate([*values, None]):
            if v is None or total + v <= 0 or total + v <= best - threshold:
                if best >= threshold:
                    parts.append((start, end))
                total, start, best, end = 0, i + 1, 0, 0
                continue
            total += v
            if total > best:
                best, end = total, i + 2
        for a, b in parts:
            if varied(steps[a : b - 1]):
                a -= len(re.search("[A-Za-z0-9]*$", run[: a + 1])[0]) - 1
                b += len(re.match("[A-Za-z0-9]*={0,2}", run[b - 1 :])[0]) - 1
                if b - a >= least and (lo + a, lo + b) not in out:
                    out.append((lo + a, lo + b))
    return sorted(out)


def planted(i):
    """A secret without a keyword, none of which the samples hold: letters and digits, or URL-safe base64."""
    b64 = base64.urlsafe_b64encode(hashlib.sha512(f"planted {i}".encode()).digest()).decode()
    return b64.replace("-", "x").replace("_", "Y")[: 28 + i % 13] if i % 2 else b64[: 32 + i % 13]


@pytest.fixture(scope="module")
def ratios(spark):
    return secrets.train(secrets.labelled_samples(spark))


ODD = [
    (1, None),
    (None, ""),
    (2, "token: token: abcdefg"),
    (2, "PASSWORD=\"x\" Passwd = 'Äabcdef' api-key: zzzzzzz api_key:secretsecret=1 apikey   ==  abcdef"),
    (3, "é𝒳 AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " x" + "0f" * 12 + "g" + "0f" * 11),
    (4, "kq8Zr3Lp0xVw7Ty2Mn5Bc1Df6 get_user_name_from_table_and_column ------------------------------"),
    (5, "token = abcdef " * 300),
    (6, "secret='" + "deadbeef" * 5 + "'"),
    (7, "x" * 200_000),
]


def test_against_brute_force(spark, ratios):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id", "text", "1 secrets_x", "2 kind")
    plain = spark.read.parquet(DATA)
    for df, rows in ((docs, ODD), (plain, [tuple(r) for r in plain.select("doc_id", "text").collect()])):
        got = [tuple(r)[:5] for r in secrets.report(secrets.scan(df, ratios)).collect()]
        assert sorted(got, key=repr) == sorted((brute(*r) for r in rows), key=repr)
        rest = {tuple(sorted(re.findall(r"markov:(\d+):(\d+)", r.spans))) for r in secrets.report(secrets.scan(df, ratios)).collect()}
        assert rest == {tuple(sorted((str(a), str(b)) for a, b in markov(t, ratios))) for _, t in rows}
    assert secrets.scan(docs.limit(0), ratios).collect() == []
    with pytest.raises(ValueError):
        secrets.scan(docs.withColumnRenamed("kind", "secrets"), ratios)


def test_planted_secrets(spark, ratios):
    """Each document of the table with a secret that no pattern knows: all are found, and nothing else is."""
    plain = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, (r.text or "") + f"\nsee {planted(r.doc_id)} there") for r in plain]
    got = {r.doc_id: re.findall(r"markov:(\d+):(\d+)", r.spans) for r in secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), ratios)).collect()}
    found = 0
    for i, text in rows:
        assert [(int(a), int(b)) for a, b in got[i]] == markov(text, ratios)
        own = len(text) - 6 - len(planted(i)), len(text) - 6
        found += own in [(int(a), int(b)) for a, b in got[i]]
        assert len(got[i]) <= 1
    assert found >= 0.99 * len(rows)


def test_many_secrets_in_one_text(spark, ratios):
    text = " ".join(f"token={planted(i)[:12]} {planted(i)}" for i in range(20_000))
    start = time.perf_counter()
    row = secrets.redact(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), ratios)).first()
    assert len(row.secrets) > 39_000 and row.text.count("[SECRET]") > 39_000 and len(row.text) < 400_000
    assert time.perf_counter() - start < 60


def test_model(spark, ratios):
    rows = {r[0]: r[1] for r in secrets.scan(spark.createDataFrame(ODD, "doc_id long, text string"), ratios).select("doc_id", "secrets").collect()}
    assert [tuple(s) for s in rows[4]] == [(0, 3, 25)]
    assert rows[7] == []
    for word in ("kq8Zr3Lp0xVw7Ty2Mn5Bc1Df6", "Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZg"):
        assert llr(ratios, word) >= 15_000
    for word in ("get_user_name_from_table_and_column", "donaudampfschifffahrtsgesellschaft", "internationalization-of-everything", "=" * 40):
        assert llr(ratios, word) < 15_000


def test_redaction(spark, ratios):
    df = secrets.redact(secrets.scan(spark.createDataFrame(ODD, "doc_id long, text string"), ratios))
    got = {r[0]: r[1] for r in df.collect()}
    assert got[6] == "[SECRET]'" and got[4].startswith("[SECRET] get_user") and got[1] is None and got[7] == "x" * 200_000
    assert got[5] == "[SECRET] " * 300


def test_untrained(spark):
    empty = secrets.train(spark.createDataFrame([], "text string, random boolean"))
    assert set(empty) == {0}
    assert secrets.train(spark.createDataFrame([(None, True), ("a", False)], "text string, random boolean")) == empty


def test_random_parts_of_runs(spark, ratios):
    path, tail = "/application/configuration/environment/server/session/", "/customer/information/account/version/"
    tokens = [base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode()[:40] for i in range(30)]
    alone = [re.sub("[+/]", "x", t)[:32] for t in tokens]
    texts = [f"{path}{t}" for t in alone] + [f"{path}{t}{tail}" for t in tokens] + [f"{path}{a}{tail}{b}" for a, b in zip(alone, alone[1:])] + [path, path + tail * 20]
    texts += [f"{'0f' * 14}/{t}" for t in alone]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(secrets.scan(df, ratios)).collect()}
    kept = [t for x, i in zip(texts, range(len(texts))) for t in (*alone, *tokens) if t in x and t[4:-4] in got[i]]
    assert kept == []
    assert all(got[i].startswith(path) for i in range(60))
    assert got[texts.index(path)] == path and got[texts.index(path + tail * 20)] == path + tail * 20

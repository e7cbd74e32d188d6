import brute
import corpus_pipeline as P
import pytest
from tabloom.llm import toxicity

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_have_their_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_near_duplicates(spark, docs):
    got = P.drop_near_duplicates(spark, docs, SF)
    assert got.columns == COLUMNS
    lost = {i for i, g in brute.near_rows(plain(docs)) if i != g}
    assert lost and sorted(plain(got)) == sorted(x for x in plain(docs) if x[0] not in lost)


def test_decontamination(spark, docs):
    got = P.drop_contaminated(spark, docs, SF)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in brute.contamination_rows(plain(docs), bench) if r[3]}
    assert got.columns == COLUMNS and sorted(plain(got)) == sorted(x for x in plain(docs) if x[0] not in hit)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: toxicity.Constant(0.0))
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, "token = abcdefgh", "en", "s", 16), (3, "token = abcdefgh", "en", "s", 16), (4, "Token =  ABCDEFGH", None, "s", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "7 node", "8 secrets", "9 row", "1 near_id", "2 near_raw", "3 secret_sizes", "4 secret_spans", "5 id", "6 y")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = stage(spark, docs, SF)
        assert docs.columns[:5] == COLUMNS, name
    got = {(r.doc_id, r.text, r.n_chars) for r in docs.collect()}
    assert got == {(1, None, None), (None, "a b c", 5), (2, "", 0), (3, "[SECRET]", 8)}
    last = P.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(len(r.doc_ids) for r in last) == 4 and any("a b c\x1e" in r.text for r in last)

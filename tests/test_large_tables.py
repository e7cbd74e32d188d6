"""What large tables need: counts in a column's own type, short expressions, outcomes that don't hang on size."""

import duckdb
from tabloom.functions.prng import SPARK
from tabloom.operators import database as D, profile as P
from tabloom.queries import database_queries as Q
from tabloom.sources import artifacts as A

SF = "/root/testdata/sf0.001"


def test_statistics_need_no_unpivoted_text(spark, monkeypatch):
    df, cols = spark.read.parquet(f"{SF}/orders.parquet"), ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    base = {r["col"]: r for r in P.basics(df, cols).join(P.ndistinct(df, cols), "col").collect()}
    common = {c: [r["value"] for r in P.most_common(df, [c]).orderBy("rank").collect()] for c in cols}
    monkeypatch.delattr(P, "unpivoted")
    got = {c.name: c for c in D.read_stats(A.stats_frame(spark, SF, ["orders"]))}
    for c in cols:
        assert (got[c].rows, got[c].null_frac, got[c].width, got[c].ndistinct) == (base[c]["row_count"], base[c]["null_percent"] / 100, base[c]["avg_width"], base[c]["ndistinct"])
        assert [v for v, _ in got[c].mcv] == common[c]


def test_expressions_are_short():
    c = D.Column("t", "c", "text", 1000, 0.0, [("a", 0.1), ("b", 0.1)], ["c", "d", "e"], 500, 18)
    assert len(D.expression(SPARK, c, "row_id", 0, "draw_c")) < 15_000


def test_factory_of_a_large_table(spark, tmp_path):
    spark.range(200_000).selectExpr("id as c_custkey", "id % 25 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    df = Q.Q["gen22_factory"](spark, str(tmp_path))
    cur = duck.execute(Q.O["gen22_factory"])
    names = [x[0] for x in cur.description]
    assert sorted(map(tuple, df.select(names).collect())) == sorted(cur.fetchall())

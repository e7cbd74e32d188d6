import json

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F
from tabloom import api
from tabloom.functions import pgtext, prng
from tabloom.operators import engine, flagship, generate as G, graph, profile as P, validate
from tabloom.plans import scope, similarity as S
from tabloom.sources import artifacts, catalog, config, ddl
from tabloom.streaming import batches

SF = "/root/testdata/sf0.001"
FILE = "host: h\nport: '5432'\ndbname: d # comment\nuser: u\npassword: p\nschema_path: a\nstat_path: b\nindex_file: c\nconstraint_file: e\nbatch_size: 50\nnested:\n  x: 1\n"


def test_flagship(spark):
    got = {r["col"]: r for r in flagship.fidelity_of_status(spark, SF).collect()}
    assert got["o_orderstatus"]["null_gap"] == 0 and got["o_orderstatus"]["ndistinct_gap"] == 0


@given(st.lists(st.one_of(st.none(), st.text(alphabet='a,"\\{} NUL', max_size=6)), max_size=5))
def test_array_literals(items):
    assert pgtext.parse_array(pgtext.render_array(items)) == items


@pytest.mark.parametrize("n", [1, 2, 7, 100, 4096])
def test_permutation(n):
    a, b = prng.permutation(n)
    assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


def test_levels_and_cycles():
    assert graph.levels(["a", "b", "c"], [("b", "a"), ("c", "b"), ("a", "a")])[0] == {"a": 0, "b": 1, "c": 2}
    level, out = graph.levels(["a", "b"], [("b", "a"), ("a", "b")], {("a", "b")})
    assert level == {"a": 0, "b": 1} and out == {("a", "b")}
    with pytest.raises(ValueError):
        graph.levels(["a", "b"], [("b", "a"), ("a", "b")])
    assert graph.mandatory("p", {"p": ["c"], "c": ["d", "p"]}, {"c": [1, 2], "d": [3]}) == [1, 2, 3]


def test_chances():
    assert [round(c, 9) for _, c in P.chances(0.1, [("a", 0.3), ("b", 0.2)], 4)] == [0.1, 0.4, 0.6, 0.7, 0.8, 0.9, 1.0]


def test_quotas():
    s = G.Stats("x", 0.1, [("a", 0.3), ("b", 0.2)], [1, 5, 9], 10)
    assert G.quotas(s, 10) == (1, [3, 2], [2, 2], [4, 3])
    assert G.pool_size(500_000, 2, 1000) == 2237
    assert abs(G.reweighted(1, 100, 2, False) - 0.999**1100) < 1e-12


def test_histogram_of_few_rows(spark):
    df = spark.createDataFrame([(i,) for i in (5, 5, 1, None, 9)], "x long")
    assert [tuple(r) for r in P.histogram(df, "x", 2, 0).orderBy("i").collect()] == [(0, 1), (1, 5), (2, 9)]
    assert P.histogram(df.limit(0), "x", 2).collect() == []


def test_draws_made_once_are_the_same(spark):
    s = G.Stats("x", 0.1, [(500, 0.3), (7, 0.2)], [0, 100, 200, 200, 1000], 400)
    once = G.normal_columns(spark.range(500), {"x": (s, "bigint")}).collect()
    assert once == spark.range(500).selectExpr("id", f"{G.normal(prng.SPARK, s, 'bigint', 'id')} as x").collect()


def test_unique_and_composite(spark):
    got = sorted(r[0] for r in G.unique_integers(spark, 6, 10, [11, 500, 3]).collect())
    assert got == [3, 10, 11, 12, 13, 500]
    pools = {"a": ([1, 2, 3], [0.9, 0.05, 0.05], "bigint"), "b": (["x", "y"], [0.5, 0.5], "string")}
    assert G.composite(spark, 6, pools).distinct().count() == 6
    with pytest.raises(ValueError):
        G.composite(spark, 7, pools)


def test_foreign_keys(spark):
    p = spark.range(50).withColumnRenamed("id", "k")
    assert G.one_to_one(spark, 50, p, ["k"]).select("k").distinct().count() == 50
    with pytest.raises(ValueError):
        G.one_to_one(spark, 51, p, ["k"])
    with pytest.raises(ValueError):
        G.one_to_many(spark, 5, p.limit(0), ["k"])
    assert G.one_to_many(spark, 200, p, ["k"]).where("k between 0 and 49").count() == 200


def test_split(spark):
    rows = [(0, 1, 1), (1, 1, 2), (2, None, 1), (3, 2, 99), (4, 3, 1)]
    df = spark.createDataFrame(rows, "row_id long, k long, p long")
    ok, bad = validate.split(df, "row_id", ["k"], [["k"]], [(["p"], spark.createDataFrame([(1,), (2,)], "id long"), ["id"])])
    assert sorted(r[0] for r in ok.collect()) == [0, 4] and sorted(r[0] for r in bad.collect()) == [1, 2, 3]


def test_fill_gives_up(spark):
    same = lambda s, first, n, salt, parents: s.range(first, first + n).selectExpr("id as row_id", "1 as k")
    with pytest.raises(ValueError):
        engine.fill(spark, 3, same, {}, {"keys": [["k"]]})


def test_write(spark, tmp_path):
    engine.write({"t": spark.range(10).selectExpr("id as row_id")}, str(tmp_path), 2)
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 10


def test_register(spark):
    engine.register(spark, {"registered": spark.range(7)}, "tabloom_test")
    try:
        found = spark.sql("describe extended tabloom_test.registered id").collect()
        assert {r["info_name"]: r["info_value"] for r in found}["distinct_count"] == "7"
    finally:
        spark.sql("drop database tabloom_test cascade")


HASH = S.Node("Hash Join", children=(S.Node("Seq Scan", "a"), S.Node("Hash", children=(S.Node("Seq Scan", "b"),))))
LOOP = S.Node("Nested Loop", children=(S.Node("Seq Scan", "a"), S.Node("Seq Scan", "b")))


def test_similarity():
    assert S.distance(HASH, LOOP) == pytest.approx(6.6) and S.similarity(HASH, LOOP) == pytest.approx(40)
    assert S.similarity(HASH, HASH) == 100 and S.similarity(None, None) == 100 and S.similarity(None, HASH) == 0
    assert S.parse("[]") is None and S.count(None) == 0


def test_plan_json(spark):
    spark.read.parquet(f"{SF}/orders.parquet").createOrReplaceTempView("orders")
    found = json.loads(api.export_query_plan(spark, "select * from orders where o_orderkey = 1", analyze=True))
    assert found[0]["Plan"]["Node Type"] == "Seq Scan" and found[0]["Plan"]["Actual Rows"] == 1
    assert found[0]["Plan"]["Relation Name"] == "orders"


def test_scope(spark):
    assert scope.relations(spark, "with x as (select 1 a) select * from x, orders o join b.c on true where exists (select 1 from d)") == ["b.c", "d", "orders"]
    assert "customer" not in api.dump_schema(spark, "select * from orders").split("CREATE TABLE", 1)[1].split("ALTER")[0]
    assert api.dump_statistic(spark, SF, "select * from nation").count() == 3
    assert len(api.dump_settings(spark)) == 7 and "bucketBy" in api.dump_layout(spark)


def test_types():
    assert [ddl.spark_type(t) for t in ("numeric(7,2)", "decimal(5)", "integer[]", "character varying(9)", "bool", "hstore", "time with time zone")] == ["decimal(7,2)", "decimal(5,0)", "array<int>", "string", "boolean", "string", "struct<seconds:bigint,offset:string>"]
    assert ddl.max_length("character(3)") == 3 and ddl.max_length("text") == -1
    assert len(ddl.schema_of("lineitem")) == 11


def test_script(spark):
    assert ddl.run_script(spark, "select 1;\nselect * from nowhere_at_all;\n")[1][1] == "no such table"
    with pytest.raises(Exception, match="PARSE"):
        ddl.run_script(spark, "selec 1;")
    assert [s.split("(")[0].strip() for s in ddl.statements(ddl.schema_script(["region"]))] == ["CREATE SCHEMA IF NOT EXISTS public", "CREATE TABLE public.region"]


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text(FILE)
    s = config.merged({"port": "1", "batch_size": None}, str(f))
    assert (s.port, s.batch_size, s.dbname, s.generation_threads) == ("1", 50, "d", 4)
    with pytest.raises(ValueError, match="host"):
        config.merged({})
    f.write_text("query: select 1\nquery-file: x\n")
    with pytest.raises(ValueError):
        config.export_settings(str(f))
    f.write_text("query: select 1\n")
    assert config.query_text(config.export_settings(str(f))) == "select 1"


def test_artifacts(spark, tmp_path):
    df = artifacts.constraints_frame(spark)
    artifacts.write_csv(df, str(tmp_path / "c"))
    assert artifacts.read_csv(spark, str(tmp_path / "c")).count() == len(catalog.CONSTRAINTS)


def test_stream(spark, tmp_path):
    q = batches.start(spark, ["id * 2 as twice"], str(tmp_path), 50, lambda df: df.where("id % 2 = 0"))
    try:
        for _ in range(60):
            if (q.lastProgress or {}).get("batchId", 0) >= 3:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    got = spark.read.parquet(*map(str, tmp_path.glob("batch=*")))
    assert got.where("id % 2 = 1 or twice <> 2 * id").count() == 0


def test_approximate_profile(spark):
    df = spark.range(1000)
    assert P.ndistinct(df, ["id"], True).first()[1] < 0
    assert len(P.quick_profile(df, "id", 4).first()["bounds"]) == 5
    assert P.most_common_elements(df.select(F.array(F.col("id") % 3).alias("a")), "a", 2).count() == 2


def test_command_line(spark, tmp_path):
    from tabloom import __main__ as cli

    f = tmp_path / "export.yaml"
    f.write_text(f"dbname: {SF}\nquery: select * from nation join region on n_regionkey = r_regionkey\nschema-file: {tmp_path}/s.sql\nexplainfile: {tmp_path}/e.json\nstats-file: {tmp_path}/stats\nconstr-file: {tmp_path}/keys\n")
    assert len(cli.export(spark, str(f))) == 4 and "CREATE TABLE public.nation" in (tmp_path / "s.sql").read_text()
    g = tmp_path / "generate.yaml"
    g.write_text("".join(f"{k}: x\n" for k in config.REQUIRED) + f"stat_path: {tmp_path}/stats\nconstraint_file: {tmp_path}/keys\n")
    assert cli.generate(spark, str(g), {"dbname": str(tmp_path / "db")}) == ["nation", "region"]
    assert spark.read.parquet(f"{tmp_path}/db/nation.parquet").count() == 25


def test_alias_tables():
    for weights in ([0.5, 0.3, 0.2], [1.0], [0.0, 1.0, 3.0, 0.5], [0.1] * 7):
        share, other = G.alias_table(weights)
        got = [0.0] * len(weights)
        for i, (s, o) in enumerate(zip(share, other)):
            got[i] += s / len(weights)
            got[o] += (1 - s) / len(weights)
        assert got == pytest.approx([w / sum(weights) for w in weights], abs=1e-9)

"""The workload's queries, sources and sinks with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabloom import api
from tabloom.functions import pgtext as X
from tabloom.functions.prng import DUCK, SPARK
from tabloom.operators import engine as E, generate as G, profile as P, validate as C
from tabloom.plans import scope, similarity as S
from tabloom.queries.common import both, read, views
from tabloom.sources import artifacts as A, catalog as K, ddl
from tabloom.streaming.batches import event_counts

ALL: dict = {}


def shared(spark) -> str:
    return f"{P.shared_dir(spark)}/artifact-{uuid.uuid4().hex}"


def micros(d: str, ts: str, hours: int) -> str:
    return f"unix_micros(cast(from_utc_timestamp({ts}, '+{hours:02d}:00') as timestamp))" if d == SPARK else f"epoch_us({ts} + interval {hours} hour)"


TRIPS = "select l_orderkey, l_linenumber, l_partkey, {a} as ordered_local, {b} as shipped_local, a.n_name as buyer, b.n_name as seller from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation a on c_nationkey = a.n_nationkey join supplier on l_suppkey = s_suppkey join nation b on s_nationkey = b.n_nationkey"
trips = lambda d: TRIPS.replace("{a}", micros(d, "o_orderdate", 7)).replace("{b}", micros(d, "l_shipdate", 3))
NAMES = ("lineitem", "orders", "customer", "nation", "supplier")
ALL["wkq1_timetable"] = both(trips, *NAMES)


def _view(s, sf):
    views(s, sf, *NAMES, "part")
    s.sql(trips(SPARK)).createOrReplaceTempView("trips")
    return s.sql("select t.*, p_brand from trips t join part on l_partkey = p_partkey where p_size > 25")


ALL["wkq2_view_join"] = (_view, f"select t.*, p_brand from ({trips(DUCK)}) t join part on l_partkey = p_partkey where p_size > 25")
ALL["wkq3_filter_join"] = both(lambda d: "select o_orderkey, o_custkey, l_linenumber, l_partkey, l_quantity from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'F'", "orders", "lineitem")
ALL["wkq4_cross"] = both(lambda d: "select r_name, n_name from region cross join nation", "region", "nation")
ALL["wkq5_lookup"] = both(lambda d: "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 100", "orders")
ALL["wkq6_join"] = both(lambda d: "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey", "orders", "customer")
ALL["wkq7_scan"] = both(lambda d: "select n_nationkey, n_name, n_regionkey from nation", "nation")
ALL["wkq8_counts"] = both(lambda d: "select count(distinct l_orderkey) as different, count(l_orderkey) as n from lineitem", "lineitem")
ALL["wkq9_series"] = both(lambda d: "select id, substr(md5(concat('login', cast(id as string))), 1, 10) as login, cast(floor(sin(id) * 1000) as bigint) as s, cast(floor(cos(id) * 1000) as bigint) as c from " + ("range(1, 5001)" if d == SPARK else "(select range as id from range(1, 5001))"))

# Sources.

ALL["src3_query_text"] = both(lambda d: "\n".join(ddl.statements("-- a comment\nselect count(*) as n\nfrom nation;\n")), "nation")
ALL["src4_script"] = (lambda s, sf: s.createDataFrame(list(enumerate(ddl.statements("-- c\nSELECT 1;\n\nSELECT a\n  FROM b;\nSELECT 3"))), "i long, statement string"), "select * from (values (0, 'SELECT 1'), (1, 'SELECT a' || chr(10) || '  FROM b'), (2, 'SELECT 3')) v(i, statement)")
ALL["src7_array_literal"] = (
    lambda s, sf: s.createDataFrame([(t, "|".join("null" if x is None else x for x in X.parse_array(t))) for t in ('{a,"b \\"c\\"",d}', '{"x,y",NULL,"NULL"}', "{}")], "text string, items string"),
    """select * from (values ('{a,"b \\"c\\"",d}', 'a|b "c"|d'), ('{"x,y",NULL,"NULL"}', 'x,y|null|NULL'), ('{}', '')) v(text, items)""",
)
ALL["src8_freqs"] = (
    lambda s, sf: s.createDataFrame([("{0.5,0.3}",), ("{}",), ("{0.25, 0.125,1}",)], "t string").select("t", F.posexplode_outer(X.frequencies(F.col("t"))).alias("i", "f")).select("t", F.col("i").cast("bigint").alias("i"), "f"),
    "select * from (values ('{0.5,0.3}', 0, 0.5::double), ('{0.5,0.3}', 1, 0.3), ('{}', null, null), ('{0.25, 0.125,1}', 0, 0.25), ('{0.25, 0.125,1}', 1, 0.125), ('{0.25, 0.125,1}', 2, 1.0)) v(t, i, f)",
)
_TYPED = "select t, {a} as as_int, {b} as as_date from (values ('12'), ('x1'), ('2024-02-30'), ('2024-02-29')) v(t)"
ALL["src9_typed"] = both(lambda d: _TYPED.replace("{a}", X.typed("t", "int")).replace("{b}", X.typed("t", "date")))
ALL["src10_zip"] = (
    lambda s, sf: s.createDataFrame([("{a,b,c}", "{0.5,0.25,0.125}")], "v string, f string").select(F.explode(F.map_from_arrays(X.plain_array(F.col("v")), X.frequencies(F.col("f")))).alias("value", "freq")),
    "select * from (values ('a', 0.5::double), ('b', 0.25), ('c', 0.125)) v(value, freq)",
)


def _stats_csv(s, sf):
    path = shared(s)
    A.write_csv(A.stats_frame(s, sf, ["orders", "nation"]), path)
    return A.read_csv(s, path).selectExpr("table_name", "column_name", "cast(row_count as bigint) as row_count", "cast(ndistinct as double) as ndistinct", "coalesce(modifiers, '') as modifiers", "coalesce(outcoming_references, '') as refs")


def _stats_sql() -> str:
    parts = []
    for t in ("orders", "nation"):
        for own, num, c, _ in K.attributes():
            if own == t:
                flags = {k for _, k, ct, key, _, _ in K.CONSTRAINTS if ct == t and num in key}
                words = " ".join(w for f, w in (("p", "PRIMARY KEY"), ("f", "FOREIGN KEY"), ("u", "UNIQUE"), ("c", "CHECK")) if f in flags)
                refs = ", ".join(f"public.{r}.{K.column_of(r, rk[0])}" for _, k, ct, key, r, rk in K.CONSTRAINTS if ct == t and k == "f" and key == [num])
                nd = f"case when count(distinct {c}) = count(*) then -1.0::double when count(distinct {c}) / count(*) > 0.1 then -round(count(distinct {c}) / count(*), 6) else count(distinct {c})::double end"
                parts.append(f"select '{t}' as table_name, '{c}' as column_name, count(*) as row_count, {nd} as ndistinct, '{words}' as modifiers, '{refs}' as refs from {t}")
    return " union all ".join(parts)


ALL["src5_stats_csv"] = (_stats_csv, _stats_sql())


def _constraints_csv(s, sf):
    path = shared(s)
    A.write_csv(A.constraints_frame(s), path)
    return A.read_csv(s, path).select("constraint_name", "type", F.posexplode(F.split("columns", ", *")).alias("i", "column")).withColumn("i", F.col("i").cast("bigint"))


_WORDS = {"p": "PRIMARY KEY", "u": "UNIQUE", "f": "FOREIGN KEY", "c": "CHECK"}
ALL["src6_constraints_csv"] = (_constraints_csv, "select * from " + K.values(DUCK, [(n, _WORDS[k], i, f"public.{t}.{K.column_of(t, c)}") for n, k, t, key, _, _ in K.CONSTRAINTS for i, c in enumerate(key)], 'constraint_name, type, i, "column"') + " v")
ALL["src12_explain_json"] = (
    lambda s, sf: s.createDataFrame([(S.count(n), S.weight(n)) for n in [S.parse('[{"Plan": {"Node Type": "Hash Join", "Plans": [{"Node Type": "Seq Scan", "Relation Name": "a"}, {"Node Type": "Hash", "Plans": [{"Node Type": "Index Scan", "Index Name": "i"}]}]}}]')]], "nodes long, weight double"),
    "select 4 as nodes, 10.5::double as weight",
)

# Sinks.


def _stored(s, sf):
    path = shared(s)
    read(s, sf, "orders").repartition(4, "o_orderkey").write.parquet(path)
    return s.read.parquet(path).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


ALL["snk1_load"] = (_stored, "select count(*) as n, sum(o_orderkey)::bigint as keys from orders")
ALL["snk5_progress"] = (lambda s, sf: s.createDataFrame([(E.write_observed(read(s, sf, "customer"), shared(s)),)], "written long"), "select count(*) as written from customer")
ALL["snk3_csv_cell"] = (lambda s, sf: s.createDataFrame([(1, "a", 5), (2, None, None)], "id long, t string, n long").select("id", X.cell(F.col("t")).alias("t"), X.cell(F.col("n"), True).alias("n")), "select * from (values (1, 'a', '{5}'), (2, 'NULL_MARKER', 'NULL_MARKER')) v(id, t, n)")
ALL["snk4_line_no"] = (lambda s, sf: s.createDataFrame([("ERROR: duplicate key, line 17, column x",), ("no number",), ("line  3",)], "m string").select("m", X.error_line(F.col("m")).alias("line")), r"select m, coalesce(try_cast(nullif(regexp_extract(m, 'line\s+(\d+)', 1), '') as int), -1) as line from (values ('ERROR: duplicate key, line 17, column x'), ('no number'), ('line  3')) v(m)")
ALL["snk8_explain"] = (lambda s, sf: s.createDataFrame([(scope.explain(read(s, sf, "orders").where("o_orderkey = 100"))[:4000],)], "plan string").selectExpr("plan like '%o_orderkey%' as names_column"), "select true as names_column")
ALL["snk9_schema"] = (lambda s, sf: s.createDataFrame([(x,) for x in ddl.statements(ddl.schema_script(["nation", "region"]))], "statement string"), None)
ALL["snk10_layout"] = (lambda s, sf: s.createDataFrame([(x,) for x in ddl.layout(list(K.COLUMNS))], "hint string"), None)
ALL["snk12_reprofile"] = (lambda s, sf: P.basics(s.range(5000).selectExpr(f"{G.quota(SPARK, G.Stats('x', 0.2, [(7, 0.5)], [0, 10, 20], 20), 5000, 'bigint', 'id')} as x"), ["x"]).select("row_count", "null_percent"), "select 5000 as row_count, 20.0::double as null_percent")

# Scope of a query.
JOIN = "with x as (select * from orders) select * from x join customer on o_custkey = c_custkey where c_nationkey in (select n_nationkey from nation)"


def _scope(s, sf):
    views(s, sf, "orders", "customer", "nation")
    return s.createDataFrame([(n,) for n in scope.relations(s, JOIN)], "relation string")


ALL["dep1_tables"] = (_scope, "select * from (values ('orders'), ('customer'), ('nation')) v(relation)")
ALL["dep2_views"] = (lambda s, sf: (views(s, sf, "orders", "customer", "nation"), s.createDataFrame([(n,) for n in scope.views(s, JOIN)], "relation string"))[1], "select * from (values ('orders'), ('customer'), ('nation')) v(relation)")
ALL["dep6_sequences"] = (lambda s, sf: s.createDataFrame([(t, K.column_of(t, key[0])) for _, k, t, key, _, _ in K.CONSTRAINTS if k == "p" and len(key) == 1], "tab string, col string"), None)


def _plan_json(s, sf):
    views(s, sf, "orders", "customer")
    tree = S.parse(api.export_query_plan(s, "select o_orderkey from orders join customer on o_custkey = c_custkey"))
    return s.createDataFrame([(sum(n.kind == "Seq Scan" for n in _all(tree)), sum("Join" in n.kind for n in _all(tree)))], "scans long, joins long")


def _all(n):
    yield n
    for c in n.children:
        yield from _all(c)


ALL["pln8_explain"] = (_plan_json, "select 2 as scans, 1 as joins")


def _database(s, sf):
    """nation, customer and orders generated level by level; what must hold of them."""
    n, c, o = 25, 600, 3000

    def nation(s, first, rows, salt, parents):
        return s.range(first, first + rows).selectExpr("id as row_id", "id % 25 as n_nationkey")

    def customer(s, first, rows, salt, parents):
        keys = G.one_to_many(s, rows, parents["nation"], ["n_nationkey"], table=f"customer{salt}")
        return keys.selectExpr(f"id + {first} as row_id", f"id + {first} as c_custkey", "n_nationkey as c_nationkey")

    def order(s, first, rows, salt, parents):
        keys = G.one_to_many(s, rows, parents["customer"], ["c_custkey"], 0.1, table=f"orders{salt}")
        return keys.selectExpr(f"id + {first} as row_id", f"(id + {first}) % {o - 200} + {salt} * {o} as o_orderkey", "c_custkey as o_custkey")

    plan = {
        "nation": (n, nation, lambda made: {"keys": [["n_nationkey"]]}),
        "customer": (c, customer, lambda made: {"keys": [["c_custkey"]], "parents": [(["c_nationkey"], made["nation"], ["n_nationkey"])]}),
        "orders": (o, order, lambda made: {"keys": [["o_orderkey"]], "parents": [(["o_custkey"], made["customer"], ["c_custkey"])]}),
    }
    made = E.generate(s, plan, [("customer", "nation"), ("orders", "customer")])
    out = None
    for t, k, fk, p, r in (("nation", "n_nationkey", None, None, None), ("customer", "c_custkey", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_orderkey", "o_custkey", "customer", "c_custkey")):
        orphans = C.foreign_violations(made[t], [fk], made[p], [r]).count() if fk else 0
        one = C.key_report(made[t], [k]).select(F.lit(t).alias("table_name"), "row_count", "holds", F.lit(orphans).cast("bigint").alias("orphans"))
        out = one if out is None else out.unionByName(one)
    return out


ALL["eng1_database"] = (_database, "select * from (values ('nation', 25, true, 0), ('customer', 600, true, 0), ('orders', 3000, true, 0)) v(table_name, row_count, holds, orphans)")
ALL["str1_event_windows"] = (lambda s, sf: event_counts(read(s, sf, "events")).selectExpr("unix_micros(cast(start as timestamp)) as start_us", "event_type", "n"), "select epoch_us(time_bucket(interval 1 hour, ts)) as start_us, event_type, count(*) as n from events group by all")

Q = {n: run for n, (run, _) in ALL.items()}
O = {n: sql for n, (_, sql) in ALL.items() if sql}

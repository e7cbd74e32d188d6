"""Generation of whole tables from exported files, and the operators around it, with their SQL twins."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from tabloom.functions.prng import DUCK, SPARK
from tabloom.operators import database as D, engine as E, generate as G, graph as R, profile as P, validate as C
from tabloom.plans import scope, similarity as S
from tabloom.queries.common import both, read, views
from tabloom.queries.workload_queries import shared
from tabloom.sources import artifacts as A, catalog as K, config

ALL: dict = {}
TABLES = ["region", "nation", "customer", "orders", "lineitem"]
FLAGS = {"customer": ["c_mktsegment"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"]}


def exported(s, sf, tables=TABLES):
    """Both files, written and read again."""
    stats, keys = shared(s), shared(s)
    A.write_csv(A.stats_frame(s, sf, tables), stats)
    A.write_csv(A.constraints_frame(s), keys)
    return A.read_csv(s, stats), A.read_csv(s, keys)


def made(s, sf):
    return D.generate(s, *exported(s, sf))


def _union(parts):
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _database(s, sf):
    """Of each generated table its rows, whether all its keys hold, how many rows have no parent, and its null keys."""
    found, parts = made(s, sf), []
    refs = [(t, K.column_of(t, k[0]), r, K.column_of(r, rk[0])) for _, kind, t, k, r, rk in K.CONSTRAINTS if kind == "f" and t in TABLES and r in TABLES]
    for t in TABLES:
        keys = [[K.column_of(t, i) for i in key] for _, kind, own, key, _, _ in K.CONSTRAINTS if own == t and kind in "pu"]
        orphans = sum(C.foreign_violations(found[t], [c], found[r], [rc]).count() for own, c, r, rc in refs if own == t)
        holds = all(C.key_report(found[t], k).first()["holds"] for k in keys)
        parts.append(found[t].agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count", F.lit(holds).alias("keys_hold"), F.lit(orphans).cast("bigint").alias("orphans")))
    return _union(parts)


ALL["gen_db_from_csv"] = (_database, " union all ".join(f"select '{t}' as table_name, count(*) as row_count, true as keys_hold, 0::bigint as orphans from {t}" for t in TABLES))


def _shares(s, sf):
    """Of each value of the columns of few values: whether its share is the source's, to within 0.03."""
    found, parts = made(s, sf), []
    for t, cols in FLAGS.items():
        for c in cols:
            counts = [df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias(n)).withColumn(n, F.col(n) / df.count()) for df, n in ((read(s, sf, t), "a"), (found[t], "b"))]
            parts.append(counts[0].join(counts[1], "value", "full").select(F.lit(c).alias("col"), "value", (F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))) < 0.03).alias("close")))
    return _union(parts)


ALL["gen_db_shares"] = (_shares, " union all ".join(f"select distinct '{c}' as col, {c} as value, true as close from {t}" for t, cols in FLAGS.items() for c in cols))

_DATES = ["1998-01-01", "1998-06-01", "2001-01-31"]
_TIMES = ["2020-01-01 00:00:00", "2020-06-01 12:30:00.5", "2021-01-01 00:00:00+03"]
KINDS = [
    D.Column("types", "a", "smallint", 2000, 0.1, [("7", 0.2), ("-3", 0.1)], ["0", "50", "50", "900"], 60, 2),
    D.Column("types", "b", "bigint", 2000, 0.0, [], ["-1000", "0", "4000000000"], -0.9, 8),
    D.Column("types", "c", "integer", 2000),
    D.Column("types", "d", "numeric(10,2)", 2000, 0.2, [("8450.00", 0.3)], ["10.50", "90.25", "1000.00"], 500, 6),
    D.Column("types", "e", "date", 2000, 0.0, [("1999-12-31", 0.4)], _DATES, 300, 4),
    D.Column("types", "f", "timestamp without time zone", 2000, 0.05, [], _TIMES, -0.9, 8),
    D.Column("types", "g", "timestamp with time zone", 2000, 0.0, [("2020-02-02 10:00:00+07", 0.5)], _TIMES, -0.4, 8),
    D.Column("types", "h", "time without time zone", 2000, 0.0, [], ["08:00:00", "12:00:00", "18:30:00"], 900, 8),
    D.Column("types", "i", "text", 2000, 0.1, [("On Time", 0.3), ("it's", 0.1)], ["apple", "apricot", "b", "b", "zoo"], 50, 9),
    D.Column("types", "j", "character varying(5)", 2000, 0.0, [], [], -1, 12),
    D.Column("types", "k", "boolean", 2000, 0.0, [("true", 0.9)]),
    D.Column("types", "l", "bytea", 2000, 0.0, [], [], -1, 4),
    D.Column("types", "m", "interval", 2000),
    D.Column("types", "n", "point", 2000),
    D.Column("types", "o", "jsonb", 2000),
    D.Column("types", "q", "character(3)", 2000, 0.0, [("SVO", 0.5), ("LED", 0.5)], [], 2, 4),
    D.Column("types", "r", "time with time zone", 2000),
    D.Column("types", "s", "tstzrange", 2000),
]


def _shown(d: str, c: D.Column) -> str:
    x = D.expression(d, c, "id")
    if c.kind.startswith("timestamp"):
        return f"unix_micros(cast({x} as timestamp))" if d == SPARK else f"epoch_us({x})"
    return f"cast({x} as string)" if c.kind.startswith("numeric") or c.kind == "date" else x


ALL["gen_all_types"] = both(lambda d: f"select id, {', '.join(f'{_shown(d, c)} as {c.name}' for c in KINDS)} from " + ("range(2000)" if d == SPARK else "(select range as id from range(2000))"))
ALL["gen_array_type"] = both(lambda d: f"select id, {G.at(d, D.expression(d, D.Column('types', 'z', 'integer[]', 2000), 'id'), '0')} as element from " + ("range(2000)" if d == SPARK else "(select range as id from range(2000))"))


def _stats_file(s, sf):
    rows = [(c.table, c.name, c.rows, c.ndistinct, len(c.mcv), c.mcv[0][1] if c.mcv else None, len(c.bounds)) for c in D.read_stats(exported(s, sf, ["orders", "nation"])[0])]
    return s.createDataFrame(rows, "table_name string, column_name string, row_count long, ndistinct double, mcvs long, top_freq double, bounds long")


def _stats_file_sql() -> str:
    parts = []
    for t in ("orders", "nation"):
        for own, _, c, _ in K.attributes():
            if own == t:
                nd = f"case when count(distinct {c}) = count(*) then -1.0::double when count(distinct {c}) / count(*) > 0.1 then -round(count(distinct {c}) / count(*), 6) else count(distinct {c})::double end"
                groups = f"(select {c} as v, count(*) as n, row_number() over (order by count(*) desc, {c}) as r from {t} where {c} is not null group by {c})"
                bounds = f"(select case when count(*) > 1 then 101 else 0 end from {groups} where n < 2 or r > 100)"
                parts.append(f"select '{t}' as table_name, '{c}' as column_name, count(*) as row_count, {nd} as ndistinct, (select count(*) from {groups} where n >= 2 and r <= 100) as mcvs, (select round(max(n) / (select count(*) from {t}), 8) from {groups} where n >= 2) as top_freq, {bounds}::bigint as bounds from {t}")
    return " union all ".join(parts)


ALL["snk6_stats_export"] = (_stats_file, _stats_file_sql())
ALL["snk7_constraints_export"] = (
    lambda s, sf: A.constraints_frame(s).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.size(F.split("columns", ", "))).alias("columns")),
    "select case kind when 'p' then 'PRIMARY KEY' when 'u' then 'UNIQUE' when 'f' then 'FOREIGN KEY' else 'CHECK' end as type, count(*) as n, sum(len(key))::bigint as columns from " + K.relation(DUCK, "con") + " c group by kind",
)


def _reloaded(s, sf):
    """Tables saved in the catalog with the statistics of all columns, and what the catalog then says of a key."""
    rows = []
    E.register(s, {t: read(s, sf, t) for t in ("nation", "customer")}, "tabloom_reload")
    try:
        for t, c in (("nation", "n_nationkey"), ("customer", "c_custkey")):
            info = {r["info_name"]: r["info_value"] for r in s.sql(f"describe extended tabloom_reload.{t} {c}").collect()}
            rows.append((t, int(info["num_nulls"]), int(info["min"]), int(info["max"])))
    finally:
        s.sql("drop database tabloom_reload cascade")
    return s.createDataFrame(rows, "table_name string, nulls long, least long, most long")


ALL["snk11_reload"] = (_reloaded, " union all ".join(f"select '{t}' as table_name, count(*) - count({c}) as nulls, min({c})::bigint as least, max({c})::bigint as most from {t}" for t, c in (("nation", "n_nationkey"), ("customer", "c_custkey"))))


def _config(s, text: str, load):
    with tempfile.TemporaryDirectory() as folder:  # the driver's own settings file
        file = Path(folder) / "settings.yaml"
        file.write_text(text)
        found = load(str(file))
    return s.createDataFrame([(str(k), str(v)) for k, v in (found if isinstance(found, dict) else vars(found)).items() if v is not None], "setting string, value string")


_REQUIRED = "".join(f"{k}: {k}_value\n" for k in config.REQUIRED)
ALL["src1_generator_settings"] = (
    lambda s, sf: _config(s, _REQUIRED + "batch_size: 50 # rows\n", lambda f: config.merged({"host": "given", "table_threads": 3}, f)),
    "select * from " + K.values(DUCK, [(k, "given" if k == "host" else f"{k}_value") for k in config.REQUIRED] + [("batch_size", "50"), ("generation_threads", "4"), ("table_threads", "3"), ("store_threads", "1")], "setting, value") + " v",
)
ALL["src2_exporter_settings"] = (
    lambda s, sf: _config(s, "dbname: 'shop'\nquery: select 1\n# none\nport: 5432\n", config.export_settings),
    "select * from (values ('dbname', 'shop'), ('query', 'select 1'), ('port', '5432')) v(setting, value)",
)
ALL["src11_catalog"] = (
    lambda s, sf: s.createDataFrame([(t, f.name, f.dataType.simpleString()) for t in ("orders", "nation") for f in read(s, sf, t).schema], "tab string, col string, typ string"),
    "select table_name as tab, column_name as col, case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' else 'timestamp_ntz' end as typ from information_schema.columns where table_name in ('orders', 'nation')",
)


def _nested_views(s, sf):
    """Views that a query reaches, through other views too, with what each of them reads."""
    views(s, sf, "orders", "customer")
    s.sql("select * from orders where o_orderstatus = 'F'").createOrReplaceTempView("scope_inner")
    s.sql("select c_name from scope_inner join customer on o_custkey = c_custkey").createOrReplaceTempView("scope_outer")
    texts = {"scope_outer": "select c_name from scope_inner join customer on o_custkey = c_custkey", "scope_inner": "select * from orders where o_orderstatus = 'F'"}
    return s.createDataFrame(scope.view_closure(s, "select * from scope_outer", texts), "view string, relation string")


ALL["dep3_view_scope"] = (_nested_views, "with recursive def(view, relation) as (select * from (values ('scope_outer', 'scope_inner'), ('scope_outer', 'customer'), ('scope_inner', 'orders')) v(view, relation)), reach(view, relation) as (select view, relation from def where view = 'scope_outer' union select d.view, d.relation from reach r join def d on d.view = r.relation) select * from reach")
ALL["dep8_order"] = (
    lambda s, sf: s.createDataFrame([(t, n) for t, n in R.levels(["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", "d")], {("c", "a")})[0].items()], "object string, place long"),
    "with recursive e(child, parent) as (select * from (values ('a', 'b'), ('b', 'c'), ('d', 'c')) v(child, parent)), up(object, place) as (select x, 0 from (values ('a'), ('b'), ('c'), ('d')) o(x) union all select child, place + 1 from up join e on parent = object) select object, max(place)::bigint as place from up group by object",
)
REFERENCING = {"orders.o_orderkey": ["lineitem.l_orderkey"], "customer.c_custkey": ["orders.o_custkey"], "part.p_partkey": ["lineitem.l_partkey"]}


def _mandatory(s, sf):
    """Values that keys must hold for the most common values of what refers to them."""
    common = {f"{t}.{c}": [int(r["value"]) for r in P.most_common(read(s, sf, t), [c], 5).collect()] for t, c in (("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("orders", "o_custkey"))}
    return s.createDataFrame([(k, v) for k in REFERENCING for v in R.mandatory(k, REFERENCING, common)], "key string, value long")


ALL["dep13_mandatory"] = (_mandatory, " union all ".join(f"select '{k}' as key, value from (select {x.split('.')[1]} as value, row_number() over (order by count(*) desc, {x.split('.')[1]}::varchar) as r from {x.split('.')[0]} group by 1 having count(*) >= 2) where r <= 5" for k, (x,) in REFERENCING.items()))

POOLS = {"a": (list(range(20)), [0.3] + [0.7 / 19] * 19, "bigint"), "b": (list("pqrst"), [0.2] * 5, "string")}


def _composite(s, sf):
    got = G.composite(s, 60, POOLS)
    return got.agg(F.count("*").alias("n"), F.count_distinct("a", "b").alias("different"), (F.count_if(F.col("a") == 0) >= 4).alias("common_first"), F.count_if(F.col("a").between(0, 19) & F.col("b").isin(list("pqrst"))).alias("inside"))


ALL["gen11_composite"] = (_composite, "select count(*) as n, count(distinct (a, b)) as different, count(*) filter (a = 0) >= 4 as common_first, count(*) as inside from (select * from range(0, 20) x(a), (values ('p'), ('q'), ('r'), ('s'), ('t')) y(b) order by a limit 60)")
ALL["gen12_mandatory"] = (
    lambda s, sf: G.composite(s, 30, POOLS, s.createDataFrame([(3, "p"), (19, "q"), (3, "p")], "a long, b string")).agg(F.count("*").alias("n"), F.count_distinct("a", "b").alias("different"), F.count_if(F.expr("a = 3 and b = 'p' or a = 19 and b = 'q'")).alias("there")),
    "select 30 as n, 30 as different, count(distinct (a, b)) as there from (values (3, 'p'), (19, 'q'), (3, 'p')) v(a, b)",
)
ALL["gen14_fresh"] = (
    lambda s, sf: s.createDataFrame([(e, v, round(w, 9)) for e in (1, 3) for v, w in zip(*G.with_fresh([1, 2, 3, 4, 5, 6, 7, 8, 9, 20], [0.1] * 10, e))], "empty long, value long, weight double"),
    "select e as empty, v as value, 0.1::double as weight from (values (1), (3)) x(e), (values (1), (2), (3), (4), (5), (6), (7), (8), (9), (20)) y(v) union all select e, 21, round(0.1::double * e, 9) from (values (1), (3)) x(e)",
)


def _related(s, sf):
    """Of each kind of relationship a child for every customer, and one more where children share parents, so that some do
    at any size: how many of the first 100 came out, whether no two share one, and those 100 less all without a parent."""
    keys, rows = read(s, sf, "customer").select("c_custkey", "c_nationkey"), []
    m = keys.count()
    n = min(100, m)
    for kind in ("ONE_TO_ONE", "ONE_TO_MANY"):
        for names in (["c_custkey"], ["c_custkey", "c_nationkey"]):
            got = G.related(s, m + (kind == "ONE_TO_MANY"), keys, names, kind, 0.25 if len(names) == 2 else 0.0)
            r = got.agg(F.count("*").alias("n"), F.count_distinct(*names).alias("d"), F.count_if(F.col("id") < n).alias("first")).first()
            outside = r["n"] - got.join(keys, names, "left_semi").count()
            rows.append((kind, len(names), r["first"], r["d"] == r["n"], r["first"] - outside))
    return s.createDataFrame(rows, "kind string, columns long, n long, different boolean, inside long")


ALL["gen22_factory"] = (_related, "select kind, columns, least(100, (select count(*) from customer)) as n, kind = 'ONE_TO_ONE' as different, least(100, (select count(*) from customer)) as inside from (values ('ONE_TO_ONE'), ('ONE_TO_MANY')) x(kind), (values (1), (2)) y(columns)")
ALL["gen24_unique_chooser"] = (
    lambda s, sf: s.createDataFrame([(t, c, "composite" if all(len(k) > 1 for k in own) else "simple") for t in K.COLUMNS for own, c in [(ks, n) for n in {K.column_of(t, i) for _, kd, o, key, _, _ in K.CONSTRAINTS if o == t and kd in "pu" for i in key} for ks in [[key for _, kd, o, key, _, _ in K.CONSTRAINTS if o == t and kd in "pu" and any(K.column_of(t, i) == n for i in key)]]]], "tab string, col string, way string"),
    "with con as " + K.relation(DUCK, "con") + ", att as " + K.relation(DUCK, "att") + " select att.tab, att.col, case when min(len(key)) > 1 then 'composite' else 'simple' end as way from att join con on att.tab = con.tab and list_contains(key, num) and kind in ('p', 'u') group by att.tab, att.col",
)


def _rollback(s, sf):
    """Rows 40 to 59 made again after a batch that broke off, beside those of one run."""
    make = lambda lo, hi: s.range(lo, hi).selectExpr("id", f"{D.expression(SPARK, KINDS[0], 'id')} as a")
    return make(0, 40).unionByName(make(40, 60)).join(make(0, 100).withColumnRenamed("a", "b"), "id").select("id", F.expr("a <=> b").alias("same"))


ALL["gen25_rollback"] = (_rollback, "select range as id, true as same from range(0, 60)")


def _retried(s, sf):
    """A maker whose first rows repeat keys: what is missing is made again, and the keys that came out."""
    same = lambda spark, first, n, salt, parents: spark.range(first, first + n).selectExpr("id as row_id", "id - id % 2 as k" if salt == 0 else "id as k")
    return E.fill(s, 40, same, {}, {"keys": [["k"]]}).agg(F.count("*").alias("n"), F.count_distinct("k").alias("different"), F.min("k").alias("least"), F.max("k").alias("most"))


ALL["val8_retry"] = (_retried, "select count(*) as n, count(distinct k) as different, min(k) as least, max(k) as most from (select range as k from range(0, 40, 2) union all select range from range(40, 60))")
_PLAN = '[{"Plan": {"Node Type": "Hash Join", "Plans": [{"Node Type": "Seq Scan", "Relation Name": "a", "Parent Relationship": "Outer"}, {"Node Type": "Hash", "Parent Relationship": "Inner", "Plans": [{"Node Type": "Index Scan", "Index Name": "i", "Parent Relationship": "Outer"}]}]}}]'


def _walk(n, depth=0):
    yield n, depth
    for c in n.children:
        yield from _walk(c, depth + 1)


ALL["pln1_parse"] = (lambda s, sf: s.createDataFrame([(n.kind, n.relation, n.index, n.side, d) for n, d in _walk(S.parse(_PLAN))], "kind string, relation string, idx string, side string, depth long"), f"""
with recursive t(node, depth) as (select json_extract('{_PLAN}', '$[0].Plan'), 0 union all select c, depth + 1 from t, lateral (select unnest(from_json(coalesce(json_extract(node, '$.Plans'), '[]'), '["JSON"]')) as c))
select json_extract_string(node, '$."Node Type"') as kind, json_extract_string(node, '$."Relation Name"') as relation, json_extract_string(node, '$."Index Name"') as idx, json_extract_string(node, '$."Parent Relationship"') as side, depth::bigint as depth from t""")
ALL["pln2_count"] = (lambda s, sf: s.createDataFrame([("plan", S.count(S.parse(_PLAN))), ("none", S.count(S.parse("[]")))], "name string, nodes long"), f"""select 'plan' as name, (len('{_PLAN}') - len(replace('{_PLAN}', '"Node Type"', ''))) // 11 as nodes union all select 'none', 0""")

Q = {n: run for n, (run, _) in ALL.items()}
O = {n: sql for n, (_, sql) in ALL.items() if sql}

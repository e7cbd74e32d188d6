"""Graph, generator, value and validation operators with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import values as V
from tabloom.functions.prng import DUCK, SPARK, below, uniform
from tabloom.operators import generate as G, graph as R, profile as P, validate as C
from tabloom.plans import similarity as S
from tabloom.queries.common import both, read, views
from tabloom.sources import catalog as K
from tabloom.sources.catalog import relation, with_catalog

ROWS = 2000
ALL: dict = {}


def series(d: str, n: int = ROWS) -> str:
    return f"(select id from range({n}))" if d == SPARK else f"(select range as id from range({n}))"


def made(column: str, *more: str):
    """One generated column over a series of rows."""

    def add(name: str, make):
        ALL[name] = both(lambda d: f"select id, {make(d)} as {column} from {series(d)}")

    return add


value = made("value")
# Values.
value("vg1_smallint", lambda d: V.integer(d, "id", "s", -5, 900, "smallint"))
value("vg2_integer", lambda d: V.integer(d, "id", "i", 10, 1_000_000, "integer"))
value("vg3_bigint", lambda d: V.integer(d, "id", "b", -(1 << 61), 1 << 61, "bigint"))
value("vg4_real", lambda d: V.floating(d, "id", "f", 0.0, 100.0, 6))
value("vg5_double", lambda d: V.floating(d, "id", "d", -3.0, 5.0, 12))
value("vg6_numeric", lambda d: f"cast({V.numeric(d, 'id', 'n', 10, 2, 90.0, 10.5)} as string)")
value("vg7_money", lambda d: f"cast({V.integer(d, 'id', 'm', -(1 << 62), 1 << 62, 'bigint')} as bigint)")
value("vg8_string", lambda d: V.text(d, "id", "t", 40))
value("vg9_string_range", lambda d: V.text_between(d, "id", "r", "apple", "apricot", 6, 12))
value("vg10_string_distinct", lambda d: V.distinct_text(d, "id", "u", 12))
value("vg11_boolean", lambda d: V.boolean(d, "id", "o"))
value("vg12_bytea", lambda d: V.bytea(d, "id", "y", 9))
value("vg13_date", lambda d: f"cast({V.date(d, 'id', 'a', '1998-01-01', '2001-06-30')} as string)")
value("vg14_timestamp", lambda d: V.integer(d, "id", "ts", 0, 4_102_444_800_000_000, "bigint"))
value("vg15_timestamptz", lambda d: f"{V.timestamptz_micros(d, chr(39) + '2025-10-01 00:00:00+07' + chr(39))} + {below(d, 86_400_000_000, 'v', 'tz', 'id')}")
value("vg16_time", lambda d: V.clock(d, V.seconds_of_day(d, "id", "tm", 3600, 7200)))
value("vg17_timetz", lambda d: f"concat({V.clock(d, V.seconds_of_day(d, 'id', 'tq', 9, 9))}, '+03')")
value("vg18_interval", lambda d: V.interval(d, "id", "iv"))
value("vg19_point", lambda d: V.point(d, "id", "pt"))
value("vg20_json", lambda d: V.json(d, "id", "js"))
ALL["vg21_tstzrange"] = both(lambda d: f"select id, {V.time_range(d, 'id', 'rg')[0]} as lo, {V.time_range(d, 'id', 'rg')[1]} as hi from {series(d)}")
value("vg22_array", lambda d: (f"array_join(array({V.integer(d, 'id', 'ar', 0, 9)}), ',')" if d == SPARK else f"array_to_string([{V.integer(d, 'id', 'ar', 0, 9)}], ',')"))
_TYPES = K.values(SPARK, [("numeric(12,3)",), ("decimal(7)",), ("numeric",), ("text",)], "typ")
ALL["vg23_numeric_type"] = both(
    lambda d: "select typ, "
    + ", ".join(f"cast(coalesce(nullif(regexp_extract(typ, {p}, {g}), ''), '{z}') as int) as {n}" for n, g, z in (("p", 2, 10), ("s", 4, 0)) for p in ((r"'(numeric|decimal)\\((\\d+)(,(\\d+))?\\)'" if d == SPARK else r"'(numeric|decimal)\((\d+)(,(\d+))?\)'"),))
    + f" from {_TYPES} t"
)

# Generators.
STATS = G.Stats("x", 0.1, [(500, 0.3), (7, 0.2)], [0, 100, 200, 200, 1000], 400)
value("gen3_normal", lambda d: G.normal(d, STATS, "bigint", "id"))
value("gen4_mcv_exclude", lambda d: G.normal(d, G.Stats("y", 0.0, [(1, 0.1), (2, 0.1), (3, 0.1)], [0, 6, 9], 9), "bigint", "id"))
value("gen5_whole_table", lambda d: G.normal(d, G.Stats("z", 0.25, [], [5, 50, 90], 80), "bigint", "id"))
value("gen6_quota", lambda d: G.quota(d, STATS, ROWS, "bigint", "id"))
value("gen8_slice", lambda d: V.distinct_integer("id", 500))
value("gen10_weighted", lambda d: G.weighted(d, ["a", "b", "c"], [0.5, 0.3, 0.2], "string" if d == SPARK else "varchar", "id", "w"))
value("gen15_regenerate", lambda d: below(d, 1000, "t", "c", "id", 1))
ALL["gen2_batch"] = both(lambda d: f"select id, {V.integer(d, 'id', 'a', 0, 10)} as a, {V.text(d, 'id', 'b', 8)} as b, {V.boolean(d, 'id', 'c')} as c from {series(d)}")
ALL["gen1_strategy"] = (
    lambda s, sf: s.createDataFrame([(p, u, f, n, G.strategy(p, u, f, n)) for p in (False, True) for u in (False, True) for f in (False, True) for n in (-1.0, 5.0)], "pk boolean, uq boolean, fk boolean, nd double, strategy string"),
    "select *, case when pk or uq or nd = -1 then 'unique' when fk then 'foreign key' else 'normal' end as strategy from (values (true), (false)) a(pk), (values (true), (false)) b(uq), (values (true), (false)) c(fk), (values (-1.0::double), (5.0::double)) d(nd)",
)
ALL["gen7_unique"] = (
    lambda s, sf: G.unique_integers(s, ROWS, 10, [11, 5000, 3]),
    f"select value from (values (3), (11), (5000)) v(value) union all select value from (select range as value from range(10, {10 + ROWS - 2})) where value not in (3, 11, 5000)",
)
ALL["gen9_pool"] = (
    lambda s, sf: s.createDataFrame([(i, w) for i, w in enumerate(G.pool_weights([("a", 0.4)], G.pool_size(ROWS, 2, 100)))], "i long, weight double").select("i", F.round("weight", 12).alias("weight")),
    f"select i, round(case when i = 0 then 0.4::double else 0.6::double / (n - 1) end, 12) as weight from (select greatest(floor(1.2 * 100), ceil(sqrt(10 * {ROWS})))::bigint as n), range(0, 1000) t(i) where i < n",
)
ALL["gen13_reweight"] = (
    lambda s, sf: s.createDataFrame([(u, e, c, round(G.reweighted(0.25, u, e, c), 9)) for u in (0, 10, 100) for e in (0, 2) for c in (False, True)], "used long, empty long, common boolean, weight double"),
    "select *, round(0.25::double * pow(0.999::double, used * (1 + 5 * empty)) * case when common then pow(0.5::double, least(20, empty)) else 1 end, 9) as weight from (values (0), (10), (100)) a(used), (values (0), (2)) b(empty), (values (true), (false)) c(common)",
)


def _keys(s, sf):
    return G.common_keys([(read(s, sf, "customer"), ["c_custkey"]), (read(s, sf, "orders"), ["o_custkey"])], ["k"])


_COMMON = "select distinct c_custkey as k from customer intersect select distinct o_custkey from orders"
ALL["gen17_fk_pool"] = (_keys, _COMMON)
_RANKED = f"with p as (select k, row_number() over (order by k) - 1 as rank, count(*) over () as m from ({_COMMON}))"
ALL["gen18_fk_1n"] = (
    lambda s, sf: G.one_to_many(s, ROWS, _keys(s, sf), ["k"], 0.2),
    _RANKED + f", d as (select id, case when {uniform(DUCK, 'fk', 'null', 'id')} < 0.2 then null else {below(DUCK, '(select max(m) from p)', 'fk', 'parent', 'id')} end as rank from {series(DUCK)}) select id, k from d left join p using (rank)",
)
_PAIR = "select distinct l_orderkey, l_linenumber from lineitem"


def _pairs(s, sf):
    return read(s, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()


_RANKED2 = f"with p as (select *, row_number() over (order by l_orderkey, l_linenumber) - 1 as rank, count(*) over () as m from ({_PAIR}))"
ALL["gen16_fk_tuples"] = (lambda s, sf: G.ranked(_pairs(s, sf), ["l_orderkey", "l_linenumber"]), _RANKED2 + " select l_orderkey, l_linenumber, rank from p")
ALL["gen19_fk_1n_comp"] = (
    lambda s, sf: G.one_to_many(s, ROWS, _pairs(s, sf), ["l_orderkey", "l_linenumber"], 0.5),
    _RANKED2 + f" select id, l_orderkey, l_linenumber from (select id, {below(DUCK, '(select max(m) from p)', 'fk', 'parent', 'id')} as rank from {series(DUCK)}) d join p using (rank)",
)
ALL["gen23_replay"] = (lambda s, sf: G.slice_of(G.ranked(read(s, sf, "part"), ["p_partkey"]), 100, 200), "select p_partkey, rank from (select p_partkey, row_number() over (order by p_partkey) - 1 as rank from part) where rank >= 100 and rank < 200")


def _one_to_one(s, sf):
    suppliers = read(s, sf, "supplier")
    return G.one_to_one(s, min(50, suppliers.count()), suppliers, ["s_suppkey"]).agg(F.count("*").alias("n"), F.count_distinct("s_suppkey").alias("different"), F.count("s_suppkey").alias("filled"))


def _one_to_one_pairs(s, sf):
    return G.one_to_one(s, 500, read(s, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey", "l_linenumber").alias("different"))


#: A bijection's multiplier depends on the number of keys, so the twins state what must hold of the result.
ALL["gen20_fk_11"] = (_one_to_one, "select least(50, count(*)) as n, least(50, count(distinct s_suppkey)) as different, least(50, count(s_suppkey)) as filled from supplier")
ALL["gen21_fk_11_comp"] = (_one_to_one_pairs, "select 500 as n, 500 as different")

# Graph.
EDGES = [(t, r) for _, k, t, _, r, _ in K.CONSTRAINTS if k == "f"]


def _cte(d: str, body: str, recursive: bool = False) -> str:
    text = with_catalog(d, body)
    return text.replace("with ", "with recursive ", 1) if recursive else text


ALL["dep4_constraint_scope"] = both(lambda d: with_catalog(d, "select name, tab from con where tab in ('orders', 'lineitem', 'nation') and (kind <> 'f' or ref in ('orders', 'lineitem', 'nation'))"))
ALL["dep5_index_scope"] = both(lambda d: with_catalog(d, "select idx.tab, idx.name from idx left join con on con.name = idx.name and con.kind = 'p' where con.name is null and idx.tab in ('orders', 'customer')"))
ALL["dep7_selection"] = both(lambda d: with_catalog(d, "select distinct att.tab from att where att.tab in ('orders') or att.tab in (select ref from edge where tab = 'orders')"))
ALL["dep9_fk_valid"] = both(lambda d: f"with att as {relation(d, 'att')}, wanted as {K.values(d, [('orders', 'o_custkey', 'customer', 'c_custkey'), ('orders', 'o_custkey', 'client', 'id'), ('nation', 'n_regionkey', 'region', 'missing')], 'tab, col, ref, refcol')} select wanted.* from wanted where exists (select 1 from att where att.tab = ref and att.col = refcol)")
_LOWEST = ", reach(tab, other) as (select tab, tab from att union select r.tab, case when e.tab = r.other then e.ref else e.tab end from reach r join edge e on e.tab = r.other or e.ref = r.other) select tab, min(other) as component from reach group by tab"
ALL["dep10_components"] = (lambda s, sf: s.createDataFrame(sorted(R.components(list(K.COLUMNS), EDGES).items()), "tab string, component string"), _cte(DUCK, _LOWEST, True))
ALL["dep11_levels"] = (
    lambda s, sf: R.levels_frame(s, K.frame(s, "edge"), K.frame(s, "att")).select("tab", F.col("level").cast("bigint").alias("level")),
    _cte(DUCK, ", up(tab, level) as (select distinct tab, 0 from att union all select e.tab, up.level + 1 from up join edge e on e.ref = up.tab) select tab, max(level)::bigint as level from up group by tab", True),
)
ALL["dep12_peers"] = both(
    lambda d: with_catalog(d, ", k as (select name, tab, kind, i, k from con " + ("lateral view posexplode(key) p as i, k" if d == SPARK else ", (select unnest(range(0, len(key))) as i, unnest(key) as k) p") + "), first as (select tab, k, min(name) as name from k where kind in ('p', 'u') group by tab, k) select a.tab, a.k, a.name, count(*) as peers from first a join k b on a.name = b.name group by a.tab, a.k, a.name")
)


ALL["dep14_rel_type"] = (
    lambda s, sf: _rel_types(s, sf),
    " union all ".join(f"select '{t}.{c}' as fk, case when count(*) = count(distinct {c}) then 'ONE_TO_ONE' else 'ONE_TO_MANY' end as rel_type from {t}" for t, c in (("labels", "doc_id"), ("orders", "o_custkey"), ("nation", "n_regionkey"))),
)


def _rel_types(s, sf):
    out = None
    for t, c in (("labels", "doc_id"), ("orders", "o_custkey"), ("nation", "n_regionkey")):
        one = C.key_report(read(s, sf, t), [c]).select(F.lit(f"{t}.{c}").alias("fk"), F.expr("case when holds then 'ONE_TO_ONE' else 'ONE_TO_MANY' end as rel_type"))
        out = one if out is None else out.unionByName(one)
    return out


# Validation: a batch with faults made from lineitem.
BATCH = "select l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey as row_id, l_orderkey, min(l_linenumber) as l_linenumber, case when l_partkey % 17 = 0 then null else l_partkey end as partkey, min(l_quantity) as l_quantity from lineitem group by l_orderkey, l_partkey, l_suppkey"


def batch(s, sf):
    views(s, sf, "lineitem")
    return s.sql(BATCH)


_B = f"with b as ({BATCH}) "
ALL["val1_unique_reject"] = (lambda s, sf: C.unique_violations(batch(s, sf), ["l_orderkey", "l_linenumber"], "row_id").select("row_id"), _B + "select row_id from (select row_id, row_number() over (partition by l_orderkey, l_linenumber order by row_id) as r from b) where r > 1")
ALL["val2_fk_reject"] = (lambda s, sf: C.foreign_violations(batch(s, sf), ["partkey"], read(s, sf, "part").where("p_partkey % 5 <> 0"), ["p_partkey"]).select("row_id"), _B + "select row_id from b where partkey is not null and partkey not in (select p_partkey from part where p_partkey % 5 <> 0)")
ALL["val3_notnull_reject"] = (lambda s, sf: C.null_violations(batch(s, sf), ["partkey"]).select("row_id"), _B + "select row_id from b where partkey is null")
ALL["val4_check_reject"] = (lambda s, sf: C.check_violations(batch(s, sf), F.expr("l_quantity < 40 and partkey > 3")).select("row_id"), _B + "select row_id from b where not coalesce(l_quantity < 40 and partkey > 3, true)")
ALL["val5_count"] = (lambda s, sf: batch(s, sf).agg(F.count("*").alias("n")), _B + "select count(*) as n from b")
ALL["val6_pk"] = (lambda s, sf: C.key_report(read(s, sf, "orders"), ["o_orderkey"]), "select count(*) as row_count, count(distinct o_orderkey) as distinct_keys, count(*) = count(distinct o_orderkey) as holds from orders")
ALL["val7_unique"] = (lambda s, sf: C.duplicate_groups(read(s, sf, "lineitem"), ["l_orderkey", "l_linenumber"]), "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")


def _split(s, sf):
    ok, _ = C.split(batch(s, sf), "row_id", ["partkey"], [["l_orderkey", "l_linenumber"]], [(["partkey"], read(s, sf, "part").where("p_partkey % 5 <> 0"), ["p_partkey"])], [F.expr("l_quantity < 40")])
    return ok.select("row_id")


_GOOD = "select *, row_number() over (partition by l_orderkey, l_linenumber order by row_id) as r from b where partkey in (select p_partkey from part where p_partkey % 5 <> 0) and l_quantity < 40"
ALL["snk2_isolation"] = (_split, _B + f"select row_id from ({_GOOD}) where r = 1")


def _fidelity(s, sf):
    a = read(s, sf, "orders").selectExpr("o_custkey as k", "o_orderstatus as st")
    b = read(s, sf, "orders").selectExpr("case when o_orderkey % 4 = 0 then null else o_custkey end as k", "'F' as st")
    prof = lambda df: P.basics(df, ["k", "st"]).join(P.ndistinct(df, ["k", "st"]), "col")
    return C.fidelity(prof(a), prof(b)).select("col", "null_gap", "made_ndistinct")


ALL["val9_fidelity"] = (_fidelity, "select 'k' as col, round(abs(0 - round(100 * avg(case when o_orderkey % 4 = 0 then 1.0 else 0.0 end), 2)), 2)::double as null_gap, case when count(distinct k) / count(*) > 0.1 then -round(count(distinct k) / count(*), 6) else count(distinct k)::double end as made_ndistinct from (select *, case when o_orderkey % 4 = 0 then null else o_custkey end as k from orders) union all select 'st', 0.0, 1.0")

# Plans.
ALL["pln3_weights"] = (
    lambda s, sf: s.createDataFrame([(k, S.weight(S.Node(k))) for k in ("Seq Scan", "Hash Join", "Sort", "Materialize")], "node string, weight double"),
    "select * from (values ('Seq Scan', 2.0::double), ('Hash Join', 3.5), ('Sort', 0.5), ('Materialize', 1.0)) v(node, weight)",
)
_HASH = S.Node("Hash Join", None, None, None, (S.Node("Seq Scan", "a"), S.Node("Hash", None, None, None, (S.Node("Seq Scan", "b"),))))
_LOOP = S.Node("Nested Loop", None, None, None, (S.Node("Seq Scan", "a"), S.Node("Seq Scan", "b")))
ALL["pln4_subtree_cost"] = (lambda s, sf: s.createDataFrame([("hash", S.weight(_HASH), S.count(_HASH)), ("loop", S.weight(_LOOP), S.count(_LOOP))], "plan string, weight double, nodes long"), "select * from (values ('hash', 11.0::double, 4), ('loop', 6.5, 3)) v(plan, weight, nodes)")
_CASES = [("same", S.Node("Sort"), S.Node("Sort")), ("relation", S.Node("Seq Scan", "a"), S.Node("Seq Scan", "b")), ("side", S.Node("Sort", side="Outer"), S.Node("Sort", side="Inner")), ("kind", S.Node("Hash"), S.Node("Seq Scan"))]
ALL["pln5_replace"] = (lambda s, sf: s.createDataFrame([(n, round(S.replace_cost(a, b), 6)) for n, a, b in _CASES], "pair string, cost double"), "select * from (values ('same', 0.0::double), ('relation', 0.4), ('side', 0.2), ('kind', 2.2)) v(pair, cost)")
ALL["pln7_similarity"] = (lambda s, sf: s.createDataFrame([(round(S.distance(_HASH, _LOOP), 6), round(S.similarity(_HASH, _LOOP), 6), S.similarity(_HASH, _HASH))], "distance double, similarity double, own double"), "select 6.6::double as distance, round((1 - 6.6::double / 11) * 100, 6) as similarity, 100.0::double as own")


def _plans(s, sf):
    views(s, sf, "orders", "customer", "nation")
    a = s.sql("select * from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F'")
    b = s.sql("select * from orders join nation on o_custkey = n_nationkey")
    x, y = S.of_query(a), S.of_query(b)
    return s.createDataFrame([(S.count(x), S.count(y), S.similarity(x, y) > 50, S.similarity(x, x))], "nodes_a long, nodes_b long, alike boolean, own double")


ALL["pln6_spark_plans"] = (_plans, None)

Q = {n: run for n, (run, _) in ALL.items()}
O = {n: sql for n, (_, sql) in ALL.items() if sql}

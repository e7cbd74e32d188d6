"""Statistics: STA1 to STA11."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import profile as P
from tabloom.queries.common import read
from tabloom.sources import catalog

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
#: Columns as text in both engines, with nulls made from keys.
ORDERS = "o_orderstatus, o_orderpriority, case when o_custkey % 10 = 0 then null else o_custkey end as custkey, o_orderkey as orderkey"
COLS = ["o_orderstatus", "o_orderpriority", "custkey", "orderkey"]


def orders(spark, sf):
    return read(spark, sf, "orders").selectExpr(*["o_orderstatus", "o_orderpriority", "case when o_custkey % 10 = 0 then null else o_custkey end as custkey", "o_orderkey as orderkey"])


def each(template: str) -> str:
    """The template for each column, united."""
    return " union all ".join(template.replace("{c}", c) for c in COLS)


def sta1(spark, sf):
    out = None
    for t in TABLES:
        one = read(spark, sf, t).agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def sta6(spark, sf):
    return P.most_common_elements(read(spark, sf, "embeddings").selectExpr("transform(embedding, x -> cast(floor(x * 10) as bigint)) as e"), "e")


def sta7(spark, sf):
    return P.histogram(read(spark, sf, "lineitem").selectExpr("cast(round(l_extendedprice * 100) as bigint) as cents"), "cents")


def sta9(spark, sf):
    return spark.sql(MODIFIERS.replace("{has}", "array_contains(key, num)").replace("{catalog}", catalog.with_catalog("spark", ", f as (select 0 as att, 0 as con, 0 as idx)").split(", f as")[0]))


MODIFIERS = """{catalog}, flags as (
  select tab, num, bool_or(kind = 'p') as pk, bool_or(kind = 'f') as fk, bool_or(kind = 'u') as uq, bool_or(kind = 'c') as ck
  from (select att.tab, att.num, con.kind from att join con on att.tab = con.tab and {has}) x group by tab, num)
select att.tab, att.col, trim(concat_ws(' ', case when pk then 'PRIMARY KEY' end, case when fk then 'FOREIGN KEY' end, case when uq then 'UNIQUE' end, case when ck then 'CHECK' end)) as modifiers
from att left join flags on att.tab = flags.tab and att.num = flags.num"""


def sta10(spark, sf):
    rows = [(k, v, spark.conf.get(v, None)) for k, v in catalog.SETTINGS.items()]
    return spark.createDataFrame(rows, "setting string, spark_setting string, value string")


def sta11(spark, sf):
    rows = [(i, k, round(c, 9)) for i, (k, c) in enumerate(P.chances(0.1, [("a", 0.3), ("b", 0.2)], 4))]
    return spark.createDataFrame(rows, "i long, kind string, upto double")


Q = {
    "sta1_row_count": sta1,
    "sta2_null_frac": lambda s, sf: P.basics(orders(s, sf), COLS).select("col", "null_percent"),
    "sta3_avg_width": lambda s, sf: P.basics(orders(s, sf), COLS).select("col", "avg_width"),
    "sta4_ndistinct": lambda s, sf: P.ndistinct(orders(s, sf), COLS),
    "sta5_mcv": lambda s, sf: P.most_common(orders(s, sf), COLS),
    "sta6_array_mcv": sta6,
    "sta7_histogram": sta7,
    "sta8_max_length": lambda s, sf: P.basics(orders(s, sf), COLS).select("col", "max_length"),
    "sta9_modifiers": sta9,
    "sta10_settings": sta10,
    "sta11_chances": sta11,
}

_O = f"with o as (select {ORDERS} from orders) "
_DUCK_CATALOG = catalog.with_catalog("duck", ", f as (select 0 as att, 0 as con, 0 as idx)").split(", f as")[0]
O = {
    "sta1_row_count": " union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in TABLES),
    "sta2_null_frac": _O + each("select '{c}' as col, round(100 * avg(case when {c} is null then 1.0 else 0.0 end), 2)::double as null_percent from o"),
    "sta3_avg_width": _O + each("select '{c}' as col, round(avg(octet_length({c}::varchar::blob)), 4) as avg_width from o"),
    "sta4_ndistinct": _O + each("select '{c}' as col, case when count(distinct {c}) = count(*) then -1.0::double when count(distinct {c}) / count(*) > 0.1 then -round(count(distinct {c}) / count(*), 6) else count(distinct {c})::double end as ndistinct from o"),
    "sta5_mcv": _O + each("select * from (select '{c}' as col, row_number() over (order by count(*) desc, {c}::varchar) as rank, {c}::varchar as value, round(count(*) / (select count(*) from o), 8) as freq from o where {c} is not null group by {c} having count(*) >= 2) where rank <= 100"),
    "sta6_array_mcv": "select * from (select row_number() over (order by count(*) desc, value) as rank, value, round(count(*) / (select count(*) from embeddings), 8) as freq from (select unnest(list_distinct(list_transform(embedding, lambda x: floor(x::double * 10)::bigint))) as value from embeddings) group by value) where rank <= 100",
    "sta7_histogram": """with c as (select round(l_extendedprice * 100)::bigint as v from lineitem), top as (select v from c group by v having count(*) >= 2 order by count(*) desc, v limit 100),
r as (select v, row_number() over (order by v) - 1 as k, count(*) over () as n from c where v not in (select v from top))
select i, v as bound from range(0, 101) t(i) join r on r.k = i * (n - 1) // 100""",
    "sta8_max_length": _O + each("select '{c}' as col, max(length({c}::varchar)) as max_length from o"),
    "sta9_modifiers": MODIFIERS.replace("{has}", "list_contains(key, num)").replace("{catalog}", _DUCK_CATALOG),
    "sta11_chances": "select * from (values (0, 'null', 0.1::double), (1, 'a', 0.4::double), (2, 'b', 0.6::double), (3, 'bucket0', 0.7::double), (4, 'bucket1', 0.8::double), (5, 'bucket2', 0.9::double), (6, 'bucket3', 1.0::double)) v(i, kind, upto)",
}

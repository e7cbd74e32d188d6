"""The key catalog of the tables at hand, as literal rows: what a database's system catalog would tell.

Rows are kept once and rendered as VALUES for either dialect; ``frame`` gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.functions.prng import SPARK

#: Columns of each table with PostgreSQL type names, in order; attribute numbers start at 1.
COLUMNS = {
    "region": "r_regionkey integer, r_name character varying(25)",
    "nation": "n_nationkey integer, n_name character varying(25), n_regionkey integer",
    "customer": "c_custkey bigint, c_name text, c_nationkey integer, c_acctbal double precision, c_mktsegment text",
    "supplier": "s_suppkey bigint, s_name text, s_nationkey integer, s_acctbal double precision",
    "part": "p_partkey bigint, p_name text, p_brand character(10), p_type text, p_size integer, p_retailprice double precision",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus character(1), o_totalprice double precision, o_orderdate timestamp without time zone, o_orderpriority text",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber integer, l_quantity double precision, l_extendedprice double precision, l_discount double precision, l_tax double precision, l_returnflag character(1), l_linestatus character(1), l_shipdate timestamp without time zone",
    "labels": "doc_id bigint, quality integer, toxic integer",
    "documents": "doc_id bigint, text text, lang text, source text, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role text, text text",
    "embeddings": "vec_id bigint, embedding real[], label integer",
}

#: Name, type (p, u, f or c), table, key's attribute numbers, table referred to, its attribute numbers.
CONSTRAINTS = [
    ("region_pkey", "p", "region", [1], None, []),
    ("region_name_key", "u", "region", [2], None, []),
    ("nation_pkey", "p", "nation", [1], None, []),
    ("nation_region_fk", "f", "nation", [3], "region", [1]),
    ("customer_pkey", "p", "customer", [1], None, []),
    ("customer_nation_fk", "f", "customer", [3], "nation", [1]),
    ("customer_name_nation_key", "u", "customer", [2, 3], None, []),
    ("supplier_pkey", "p", "supplier", [1], None, []),
    ("supplier_nation_fk", "f", "supplier", [3], "nation", [1]),
    ("part_pkey", "p", "part", [1], None, []),
    ("part_size_check", "c", "part", [5], None, []),
    ("orders_pkey", "p", "orders", [1], None, []),
    ("orders_customer_fk", "f", "orders", [2], "customer", [1]),
    ("lineitem_order_part_supp_key", "u", "lineitem", [1, 2, 3], None, []),
    ("lineitem_order_fk", "f", "lineitem", [1], "orders", [1]),
    ("lineitem_part_fk", "f", "lineitem", [2], "part", [1]),
    ("lineitem_supplier_fk", "f", "lineitem", [3], "supplier", [1]),
    ("documents_pkey", "p", "documents", [1], None, []),
    ("labels_pkey", "p", "labels", [1], None, []),
    ("labels_document_fk", "f", "labels", [1], "documents", [1]),
    ("conversations_pkey", "p", "conversations", [1, 2], None, []),
    ("embeddings_pkey", "p", "embeddings", [1], None, []),
]

#: Table, index, whether unique, its attribute numbers; those of constraints bear their names.
INDEXES = [
    *[(t, n, True, k) for n, kind, t, k, _, _ in CONSTRAINTS if kind in "pu"],
    ("customer", "customer_mktsegment_idx", False, [5]),
    ("orders", "orders_orderdate_idx", False, [5]),
    ("supplier", "supplier_name_idx", True, [2]),
    ("lineitem", "lineitem_shipdate_idx", False, [11]),
]

#: How planner settings are called there and here.
SETTINGS = {"work_mem": "spark.memory.fraction", "random_page_cost": "spark.sql.files.openCostInBytes", "seq_page_cost": "spark.sql.files.maxPartitionBytes", "effective_cache_size": "spark.memory.storageFraction", "max_parallel_workers_per_gather": "spark.sql.shuffle.partitions", "jit": "spark.sql.codegen.wholeStage", "default_statistics_target": "spark.sql.statistics.histogram.numBins"}


def attributes() -> list[tuple[str, int, str, str]]:
    """table, number, column, type."""
    out = []
    for t, text in COLUMNS.items():
        for i, part in enumerate(text.split(", "), 1):
            name, _, kind = part.partition(" ")
            out.append((t, i, name, kind))
    return out


def column_of(table: str, number: int) -> str:
    return next(c for t, i, c, _ in attributes() if (t, i) == (table, number))


def _cell(d: str, x) -> str:
    if x is None:
        return "cast(null as string)"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list):
        return ("array(%s)" if d == SPARK else "[%s]") % ", ".join(map(str, x)) if x else ("cast(array() as array<int>)" if d == SPARK else "cast([] as int[])")
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(d: str, rows: list[tuple], names: str) -> str:
    """(VALUES ...) AS alias(names) without the alias: a derived table of literal rows."""
    body = ", ".join("(" + ", ".join(_cell(d, x) for x in r) + ")" for r in rows)
    return f"(select * from (values {body}) as v({names}))"


def relation(d: str, name: str) -> str:
    """att(tab, num, col, typ), con(name, kind, tab, key, ref, refkey), idx(tab, name, uniq, key) or fk edges."""
    if name == "att":
        return values(d, attributes(), "tab, num, col, typ")
    if name == "con":
        return values(d, CONSTRAINTS, "name, kind, tab, key, ref, refkey")
    if name == "idx":
        return values(d, INDEXES, "tab, name, uniq, key")
    if name == "edge":
        return values(d, [(t, column_of(t, k[0]), r, column_of(r, rk[0])) for _, kind, t, k, r, rk in CONSTRAINTS if kind == "f"], "tab, col, ref, refcol")
    raise KeyError(name)


def frame(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"select * from {relation(SPARK, name)}")


def with_catalog(d: str, body: str) -> str:
    """A statement over the catalog's relations that it names."""
    used = [n for n in ("att", "con", "idx", "edge") if n in body]
    return "with " + ", ".join(f"{n} as {relation(d, n)}" for n in used) + (", " if body.lstrip().startswith(",") else " ") + body.lstrip().lstrip(",")

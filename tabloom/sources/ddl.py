"""Type names and scripts of a PostgreSQL schema, and how our tables are rendered as one."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession, types as T

from tabloom.sources import catalog

#: PostgreSQL names of types and what Spark has for them; anything else is text.
TYPES = {
    "smallint": "smallint", "int2": "smallint", "integer": "int", "int4": "int", "int": "int", "bigint": "bigint", "int8": "bigint",
    "real": "float", "float4": "float", "double precision": "double", "float8": "double", "numeric": "decimal(38,18)", "decimal": "decimal(38,18)", "money": "decimal(19,2)",
    "boolean": "boolean", "bool": "boolean", "bytea": "binary", "date": "date",
    "timestamp": "timestamp_ntz", "timestamp without time zone": "timestamp_ntz", "timestamp with time zone": "timestamp", "timestamptz": "timestamp",
    "time": "bigint", "time without time zone": "bigint", "time with time zone": "struct<seconds:bigint,offset:string>", "timetz": "struct<seconds:bigint,offset:string>",
    "interval": "string", "point": "struct<x:double,y:double>", "json": "string", "jsonb": "string", "tstzrange": "struct<lo:timestamp,hi:timestamp>",
}


def spark_type(name: str) -> str:
    """A type's name in Spark: T[] is an array, numeric(p,s) and decimal(p,s) a decimal (10 and 0 by default within
    brackets), sizes of character types are dropped."""
    name = " ".join(name.strip().lower().split())
    if name.endswith("[]"):
        return f"array<{spark_type(name[:-2])}>"
    if m := re.fullmatch(r"(?:numeric|decimal)\s*\((\d+)\s*(?:,\s*(\d+))?\)", name):
        return f"decimal({m[1]},{m[2] or 0})"
    return TYPES.get(name) or TYPES.get(re.sub(r"\s*\(\d+\)", "", name), "string")


def max_length(name: str) -> int:
    """Characters that a type allows, -1 without a limit."""
    m = re.fullmatch(r"(?:character varying|varchar|character|char|bpchar)\s*\((\d+)\)", name.strip().lower())
    return int(m[1]) if m else -1


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{c}` {spark_type(k)}" for t, _, c, k in catalog.attributes() if t == table))


def statements(script: str) -> list[str]:
    """Statements of a script: lines that begin with -- are skipped, a line that ends with ; ends a statement; what is
    left at the end without one is a statement too."""
    out, now = [], []
    for line in script.splitlines():
        if line.strip().startswith("--") or not line.strip() and not now:
            continue
        now.append(line)
        if line.rstrip().endswith(";"):
            out.append("\n".join(now).rstrip().rstrip(";").strip())
            now = []
    if "\n".join(now).strip():
        out.append("\n".join(now).strip())
    return [s for s in out if s]


def run_script(spark: SparkSession, script: str) -> list[tuple[str, str]]:
    """(statement, outcome) of each; a missing table only warns, every other error ends the run."""
    out = []
    for s in statements(script):
        try:
            spark.sql(s).collect()
            out.append((s, "done"))
        except Exception as e:
            if "TABLE_OR_VIEW_NOT_FOUND" not in str(e):
                raise
            out.append((s, "no such table"))
    return out


def create_table(table: str, schema: str = "public") -> str:
    """CREATE TABLE with the keys that belong to the table alone."""
    lines = [f"  {c} {k}" for t, _, c, k in catalog.attributes() if t == table]
    words = {"p": "PRIMARY KEY", "u": "UNIQUE"}
    lines += [f"  CONSTRAINT {n} {words[k]} ({', '.join(catalog.column_of(t, i) for i in key)})" for n, k, t, key, _, _ in catalog.CONSTRAINTS if t == table and k in words]
    return f"CREATE TABLE {schema}.{table} (\n" + ",\n".join(lines) + "\n);"


def foreign_keys(tables: list[str], schema: str = "public") -> list[str]:
    """ALTER TABLE of each foreign key whose parent is among the tables."""
    names = lambda t, key: ", ".join(catalog.column_of(t, i) for i in key)
    return [f"ALTER TABLE {schema}.{t} ADD CONSTRAINT {n} FOREIGN KEY ({names(t, key)}) REFERENCES {schema}.{r} ({names(r, rk)});" for n, k, t, key, r, rk in catalog.CONSTRAINTS if k == "f" and t in tables and r in tables]


def layout(tables: list[str]) -> list[str]:
    """What stands for indexes: a bucketing and sort order by the key of each index that no constraint made."""
    made = {n for n, *_ in catalog.CONSTRAINTS}
    return [f"{t}: bucketBy(64, {', '.join(map(repr, cols))}).sortBy({', '.join(map(repr, cols))})" for t, n, _, key in catalog.INDEXES if t in tables and n not in made for cols in [[catalog.column_of(t, i) for i in key]]]


def schema_script(tables: list[str]) -> str:
    """Schema, tables and then foreign keys."""
    return "\n\n".join(["CREATE SCHEMA IF NOT EXISTS public;", *[create_table(t) for t in tables], *foreign_keys(tables)]) + "\n"

"""What a query depends on, read from its analysed plan before the optimiser drops anything."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def relations(spark: SparkSession, query: str) -> list[str]:
    """Names of tables and views that a query's text refers to, sorted, once each; names of its own WITH clauses
    don't count."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    text = plan.treeString()
    found = re.findall(r"'UnresolvedRelation \[([^\]]+)\]", text)
    own = {x.lower() for x in re.findall(r"(?:CTE|'UnresolvedWith|SubqueryAlias) \[?(\w+)", text)} | {m.lower() for m in re.findall(r"(?i)\b(?:with(?:\s+recursive)?|,)\s+(\w+)(?:\s*\([^)]*\))?\s+as\s*\(", query)}
    names = [x.replace(", ", ".") for x in found]
    return sorted({n for n in names if n.lower() not in own})


def views(spark: SparkSession, query: str) -> list[str]:
    """Those of a query's relations that are views."""
    return [n for n in relations(spark, query) if (t := _table(spark, n)) and t.tableType in ("VIEW", "TEMPORARY")]


def view_closure(spark: SparkSession, query: str, texts: dict[str, str]) -> list[tuple[str, str]]:
    """(view, relation): of the views that a query reaches, through other views too, what each one reads. texts are the
    views' definitions; each view is visited once."""
    todo, seen, out = relations(spark, query), set(), []
    while todo:
        name = todo.pop()
        if name in texts and name not in seen:
            seen.add(name)
            below = relations(spark, texts[name])
            out += [(name, r) for r in below]
            todo += below
    return out


def _table(spark: SparkSession, name: str):
    return spark.catalog.getTable(name) if spark.catalog.tableExists(name) else None


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text: simple, extended, codegen, cost or formatted."""
    qe = df._jdf.queryExecution()
    return qe.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def analysed(df: DataFrame) -> tuple[str, int]:
    """The plan that ran, with its metrics' rows: the query is executed."""
    n = df.count()
    return explain(df, "formatted"), n

"""What can be asked for a whole database, or for the tables of one query."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tabloom.plans import scope, similarity
from tabloom.sources import artifacts, catalog, ddl


def _tables(spark: SparkSession, query: str | None) -> list[str]:
    if query is None:
        return list(catalog.COLUMNS)
    return [t for t in catalog.COLUMNS if t in {n.split(".")[-1].lower() for n in scope.relations(spark, query)}]


def dump_schema(spark: SparkSession, query: str | None = None) -> str:
    return ddl.schema_script(_tables(spark, query))


def dump_layout(spark: SparkSession, query: str | None = None) -> str:
    return "\n".join(ddl.layout(_tables(spark, query)))


def dump_statistic(spark: SparkSession, sf_dir: str, query: str | None = None) -> DataFrame:
    """Statistics of the tables that are there."""
    return artifacts.stats_frame(spark, sf_dir, [t for t in _tables(spark, query) if artifacts.exists(spark, f"{sf_dir}/{t}.parquet")])


def dump_settings(spark: SparkSession) -> dict[str, str | None]:
    return {k: spark.conf.get(v, None) for k, v in catalog.SETTINGS.items()}


def export_query_plan(spark: SparkSession, query: str, analyze: bool = False) -> str:
    """The query's plan as JSON, in the shape that similarity.parse reads; with analyze it is run and its rows counted."""
    df = spark.sql(query)
    as_json = lambda n: {"Node Type": n.kind, **({"Relation Name": n.relation} if n.relation else {}), **({"Plans": [as_json(c) for c in n.children]} if n.children else {})}
    root = similarity.of_query(df)
    found = {"Plan": as_json(root)} if root else {}
    if analyze and root:
        found["Plan"]["Actual Rows"] = df.count()
    return json.dumps([found], indent=2)

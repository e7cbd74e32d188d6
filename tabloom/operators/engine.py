"""Generation of whole databases: tables level by level, each validated, short ones filled up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tabloom.operators import validate
from tabloom.operators.graph import Edge, levels
from tabloom.operators.profile import checkpointed

#: make(spark, first row, rows, salt, parents) gives rows with a column row_id and the table's own.
Maker = Callable[[SparkSession, int, int, int, dict[str, DataFrame]], DataFrame]


def fill(spark: SparkSession, n: int, make: Maker, parents: dict[str, DataFrame], rules: dict, retries: int = 3) -> DataFrame:
    """n rows that keep the rules (those of validate.split). Rows that break one are made again with another salt, a
    bounded number of times; fewer rows than asked are an error, as is a round that adds none."""
    kept, have = None, 0
    for salt in range(retries + 1):
        more = make(spark, salt * n, n - have, salt, parents)
        for key in rules.get("keys", ()) if kept is not None else ():  # kept rows are not judged again
            more = more.join(kept.select(*key), list(key), "left_anti").select(*kept.columns)
        ok, _ = validate.split(more, "row_id", **rules)
        kept = checkpointed(ok if kept is None else kept.unionByName(ok))
        before, have = have, kept.count()
        if have == n or salt and have == before:
            break
    if have < n:
        raise ValueError(f"{n} rows can't be made in {retries} retries")
    return kept


def generate(spark: SparkSession, plan: dict[str, tuple[int, Maker, Callable[[dict[str, DataFrame]], dict]]], edges: list[Edge], nullable: set[Edge] = frozenset()) -> dict[str, DataFrame]:
    """All tables of plan (rows, maker, rules from the tables made before), parents first. Children see accepted rows
    only; a table's rows are released once its last child is made."""
    level, _ = levels(list(plan), edges, nullable)
    made: dict[str, DataFrame] = {}
    for name in sorted(plan, key=lambda t: (level[t], t)):
        n, make, rules = plan[name]
        made[name] = fill(spark, n, make, made, rules(made))
    return made


def write(tables: dict[str, DataFrame], folder: str, files: int = 8) -> None:
    for name, df in tables.items():
        df.repartition(files, F.col("row_id")).sortWithinPartitions("row_id").write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_observed(df: DataFrame, path: str) -> int:
    """Write df and tell how many rows went out, counted on the way and not by a second pass."""
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"]


def register(spark: SparkSession, tables: dict[str, DataFrame], database: str = "default") -> None:
    """Save tables in the catalog and compute the statistics of all their columns, for the cost-based optimiser."""
    spark.sql(f"create database if not exists {database}")
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}")
        spark.sql(f"analyze table {database}.{name} compute statistics for all columns")

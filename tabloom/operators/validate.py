"""Integrity: rows that break a constraint are set apart, the earliest row of a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _whole(keys: list[str]) -> Column:
    """No column of the key is null."""
    return F.expr(" and ".join(f"`{k}` is not null" for k in keys))


def _first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The keys that several rows have, with the earliest of each: one row a key, and none for a key that is one."""
    first = df.where(_whole(keys)).groupBy(*keys).agg(F.min(order).alias("split_first"), F.count("*").alias("split_n"))
    return first.where("split_n > 1").drop("split_n")


def unique_violations(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with a key without nulls that an earlier row has. The winner is found by a partial minimum; only keys that
    repeat are joined back. A row without an order comes after those with one."""
    late = F.col(order).isNull() & F.col("split_first").isNotNull() | (F.col(order) > F.col("split_first"))
    return df.join(_first_of(df, keys, order), keys).where(late).select(*df.columns)


def foreign_violations(df: DataFrame, keys: list[str], parent: DataFrame, refs: list[str]) -> DataFrame:
    """Rows whose key, if it has no null, no parent row has."""
    ref = parent.select(*[F.col(r).alias(f"ref_{i}") for i, r in enumerate(refs)])
    same = [F.col(k) == F.col(f"ref_{i}") for i, k in enumerate(keys)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return df.where(F.expr(" and ".join(f"{k} is not null" for k in keys))).join(ref, cond, "left_anti")


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(F.expr(" or ".join(f"{c} is null" for c in columns)))


def check_violations(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which the check is false; null passes."""
    return df.where(~F.coalesce(check, F.lit(True)))


def split(df: DataFrame, order: str, not_null: list[str] = (), keys: list[list[str]] = (), parents: list[tuple[list[str], DataFrame, list[str]]] = (), checks: list[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). Nulls, checks and foreign keys are judged first: a row that they reject claims no key.

    Nulls and checks are a flag of the row itself, a parent is looked up by one join a foreign key, and the earliest row
    of a key that repeats by another; the row's number is never joined on."""
    bad = F.lit(False)
    for c in not_null:
        bad = bad | F.col(c).isNull()
    for c in checks:
        bad = bad | ~F.coalesce(c, F.lit(True))
    judged = df.withColumn("split_bad", bad)
    for i, (own, parent, refs) in enumerate(parents):
        ref = parent.select(*[F.col(r).alias(f"split_ref_{j}") for j, r in enumerate(refs)]).distinct().withColumn("split_there", F.lit(True))
        same = F.lit(True)
        for j, k in enumerate(own):
            same = same & (F.col(k) == F.col(f"split_ref_{j}"))
        judged = judged.join(ref, same, "left").withColumn("split_bad", F.col("split_bad") | (_whole(own) & F.col("split_there").isNull())).select(*df.columns, "split_bad")
    for k in keys:
        first = _first_of(judged.where(~F.col("split_bad")), k, order)
        late = F.col("split_first").isNotNull() & (F.col(order).isNull() | (F.col(order) > F.col("split_first")))
        judged = judged.join(first, k, "left").withColumn("split_bad", F.col("split_bad") | F.coalesce(late, F.lit(False))).select(*df.columns, "split_bad")
    return judged.where(~F.col("split_bad")).drop("split_bad"), judged.where(F.col("split_bad")).drop("split_bad")


def key_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """row_count, distinct_keys and whether the key is one."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"), F.count("*").alias("distinct_keys")).withColumn("holds", F.col("row_count") == F.col("distinct_keys"))


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fidelity(source: DataFrame, made: DataFrame) -> DataFrame:
    """Profiles (col, null_percent, ndistinct) of a source and of what was generated from it, side by side."""
    a = source.select("col", F.col("null_percent").alias("source_null"), F.col("ndistinct").alias("source_ndistinct"))
    b = made.select("col", F.col("null_percent").alias("made_null"), F.col("ndistinct").alias("made_ndistinct"))
    return a.join(b, "col").withColumn("null_gap", F.round(F.abs(F.col("source_null") - F.col("made_null")), 2)).withColumn("ndistinct_gap", F.round(F.abs(F.col("source_ndistinct") - F.col("made_ndistinct")), 6))

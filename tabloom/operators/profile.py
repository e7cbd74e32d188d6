"""Column statistics of a table: what an ANALYZE would keep of it.

Columns are unpivoted once into (col, value as text, width), so that every statistic of every column comes from one
pass and one shuffle of partial counts. No step ranks all values of a column in one task: most common values are cut to
the best of each partition before they meet, and histogram bounds come from ranges whose offsets are summed first."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Values kept as most common, and buckets of a histogram.
MOST_COMMON, BUCKETS = 100, 100


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own if Spark runs in one process, as in tests;
    on a cluster that is an error, since its machines would not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.gettempdir()}/checkpoints"
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder that shared_dir names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, value): a row per row of df and column; values as text, null where null."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) as (col, value)")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, value, cnt), null among the values."""
    return unpivoted(df, columns).groupBy("col", "value").agg(F.count("*").alias("cnt"))


def null_fraction(flag: Column) -> Column:
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def basics(df: DataFrame, columns: list[str]) -> DataFrame:
    """col, row_count, null_percent (0 to 100, two decimals; 0 of an empty table), avg_width in bytes, max_length in
    characters (-1 without a value)."""
    own = unpivoted(df, columns)
    return own.groupBy("col").agg(
        F.count("*").alias("row_count"),
        F.round(100 * null_fraction(F.col("value").isNull()), 2).alias("null_percent"),
        F.coalesce(F.round(F.avg(F.octet_length("value")), 4), F.lit(0.0)).alias("avg_width"),
        F.coalesce(F.max(F.length("value")), F.lit(-1)).cast("bigint").alias("max_length"),
    )


def ndistinct(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """col, ndistinct in the signed convention: -1 if all rows differ, minus the share of rows if over a tenth of them
    do, else the number."""
    if approximate:
        own = unpivoted(df, columns).groupBy("col").agg(F.count("*").alias("n"), F.approx_count_distinct("value").alias("d"))
    else:
        own = value_counts(df, columns).groupBy("col").agg(F.sum("cnt").alias("n"), F.count("value").alias("d"))
    share = F.col("d") / F.col("n")
    signed = F.when(F.col("d") == F.col("n"), F.lit(-1.0)).when(share > 0.1, -F.round(share, 6)).otherwise(F.col("d").cast("double"))
    return own.select("col", signed.alias("ndistinct"))


def most_common(df: DataFrame, columns: list[str], k: int = MOST_COMMON, least: int = 2) -> DataFrame:
    """col, rank, value, freq: up to k values of at least `least` rows each, by falling count and then value; freq is
    the share of all rows, nulls included."""
    counts = value_counts(df, columns)
    return _ranked(counts, k, least)


def _ranked(counts: DataFrame, k: int, least: int) -> DataFrame:
    total = counts.groupBy("col").agg(F.sum("cnt").alias("n"))
    w = Window.partitionBy("col").orderBy(F.desc("cnt"), "value")
    top = counts.where(F.col("value").isNotNull() & (F.col("cnt") >= least)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(F.broadcast(total), "col").select("col", F.col("rank").cast("bigint").alias("rank"), "value", F.round(F.col("cnt") / F.col("n"), 8).alias("freq"))


def most_common_elements(df: DataFrame, column: str, k: int = MOST_COMMON) -> DataFrame:
    """rank, value, freq of an array's elements; freq is the share of rows that have the element."""
    n = df.agg(F.count("*").alias("n"))
    elements = df.select(F.explode(F.array_distinct(column)).alias("value")).groupBy("value").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("cnt"), "value")
    top = elements.orderBy(F.desc("cnt"), "value").limit(k).withColumn("rank", F.row_number().over(w).cast("bigint"))
    return top.join(F.broadcast(n)).select("rank", "value", F.round(F.col("cnt") / F.col("n"), 8).alias("freq"))


def histogram(df: DataFrame, column: str, buckets: int = BUCKETS, k: int = MOST_COMMON, least: int = 2) -> DataFrame:
    """i (0 to buckets), bound: order statistics at floor(i * (n - 1) / buckets) of the n non-null rows whose value is
    not among the k most common ones (k = 0: of all).

    Equal-depth bounds are exact and need no global sort in one task: values are counted, range-partitioned, and each
    range's rows are offset by the sums of the ranges before it."""
    return bounds(typed_counts(df, column), buckets, k, least)


def typed_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, cnt) of one column in its own type, null among the values."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("cnt"))


def facts(counts: DataFrame, column: str) -> DataFrame:
    """col, row_count, null_percent, avg_width and ndistinct as basics() and ndistinct() have them, and the number of
    different values, from typed_counts(); no row of an empty table."""
    there, n, d = F.col("value").isNotNull(), F.sum("cnt"), F.count("value")
    width = F.try_divide(F.sum(F.octet_length(F.col("value").cast("string")) * F.col("cnt")), F.sum(F.when(there, F.col("cnt"))))
    signed = F.when(d == n, F.lit(-1.0)).when(d / n > 0.1, -F.round(d / n, 6)).otherwise(d.cast("double"))
    return counts.agg(
        F.lit(column).alias("col"),
        n.alias("row_count"),
        F.round(100 * (F.sum(F.when(there, F.lit(0)).otherwise(F.col("cnt"))) / n), 2).alias("null_percent"),
        F.coalesce(F.round(width, 4), F.lit(0.0)).alias("avg_width"),
        signed.alias("ndistinct"),
        d.alias("different"),
    ).where("row_count > 0")


def commonest(counts: DataFrame, k: int = MOST_COMMON, least: int = 2) -> DataFrame:
    """(value, cnt) of the values that most_common() has of one column, as text, from typed_counts()."""
    own = counts.where(F.col("value").isNotNull() & (F.col("cnt") >= least)).select(F.col("value").cast("string").alias("value"), "cnt")
    return own.orderBy(F.desc("cnt"), "value").limit(k)


def bounds(counts: DataFrame, buckets: int = BUCKETS, k: int = MOST_COMMON, least: int = 2) -> DataFrame:
    """What histogram() gives, from typed_counts()."""
    counts = counts.where(F.col("value").isNotNull())
    if k:
        top = counts.where(F.col("cnt") >= least).orderBy(F.desc("cnt"), "value").limit(k).select("value")
        counts = counts.join(F.broadcast(top), "value", "left_anti")
    ranged = checkpointed(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("cnt").alias("own"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("ahead"))
    total = ranged.agg(F.sum("cnt").alias("n"))
    w = Window.partitionBy("part").orderBy("value")
    placed = ranged.join(F.broadcast(offsets), "part").withColumn("last", F.col("ahead") + F.sum("cnt").over(w) - 1)
    wanted = total.where("n > 0").select(F.explode(F.sequence(F.lit(0), F.lit(buckets))).alias("i"), "n").select("i", F.expr(f"i * (n - 1) div {buckets}").alias("k"))
    hit = placed.join(F.broadcast(wanted), (F.col("k") <= F.col("last")) & (F.col("k") > F.col("last") - F.col("cnt")))
    return hit.select(F.col("i").cast("bigint").alias("i"), F.col("value").alias("bound"))


def quick_profile(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """One pass without a shuffle of values: approximate distinct count, bounds and most common values."""
    points = F.array(*[F.lit(i / buckets) for i in range(buckets + 1)])
    return df.agg(F.count("*").alias("row_count"), F.approx_count_distinct(column).alias("ndistinct"), F.percentile_approx(column, points).alias("bounds"))


def chances(null_frac: float, mcv: list[tuple[str, float]], buckets: int) -> list[tuple[str, float]]:
    """Cumulative chances: null, then each most common value, then equal shares of what is left for the buckets."""
    out, at = [("null", null_frac)], null_frac
    for value, freq in mcv:
        at += freq
        out.append((value, at))
    return out + [(f"bucket{i}", at + (i + 1) * (1 - at) / buckets) for i in range(buckets)]

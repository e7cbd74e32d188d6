"""What the operators share: tables, the shared folder and cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting that lets shuffle files go as soon as the query that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if Spark runs in
    one process, as in tests; on a cluster that is an error, since its machines would not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that what follows neither repeats the work nor
    depends on executors that made it. What the writing shuffled goes with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a table that stored() gave and nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def joined(large: DataFrame, unique: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, parts: int = 512) -> DataFrame:
    """large joined with unique, which has one row at most for each of the keys (named alike in both, not null).

    Keys that hold more than a `parts`th of large's rows are `parts` at most, whatever the size: their rows of unique are
    broadcast, and large's rows with them stay where they are. All other keys are shuffled, and none of them makes a
    task much larger than others. counts: keys and joined_n, how many rows of large have them, where that is known."""
    if counts is None:
        counts = large.groupBy(*keys).agg(F.count("*").alias("joined_n"))
    total = counts.agg(F.coalesce(F.sum("joined_n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("joined_n") > max(100, total // parts)).select(*keys)
    rows = hot.collect()  # `parts` rows at most
    if not rows:
        return large.join(unique, keys, how)
    hot = F.broadcast(large.sparkSession.createDataFrame(rows, hot.schema))
    near = large.join(hot, keys, "left_semi").join(F.broadcast(unique.join(hot, keys, "left_semi")), keys, how)
    return near.unionByName(large.join(hot, keys, "left_anti").join(unique, keys, how))


def by_pieces(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """In a worker: what make gives of each piece of `rows` rows at most. A batch goes before the next one is read, and
    after the last one Arrow gives back what it keeps in reserve, since idle workers stay through the stages to come."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield make(b.slice(lo, rows))
        del b
    pa.default_memory_pool().release_unused()


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, marked for broadcast if it has at most `most` rows (of a few numbers each); larger ones are shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


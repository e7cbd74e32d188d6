"""Generation as a stream: each micro-batch of row numbers becomes a validated batch of rows.

Rows are functions of their numbers, so the only state is the stream's own offset: a batch that is run again after a
failure makes the same rows, and overwrites the same folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery


def start(spark: SparkSession, columns: list[str], folder: str, rows_per_second: int = 10_000, rules: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write generated columns (SQL over the row number `id`) to folder/batch=N; rules may drop rows of a batch."""

    def write(df: DataFrame, batch: int) -> None:
        made = df.select(F.col("value").alias("id")).selectExpr("id", *columns)
        (rules(made) if rules else made).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    source = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return source.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_offsets").start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each window and type, for streams (with a watermark) and tables alike."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")

"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.functions.prng import DUCK, SPARK


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        read(spark, sf_dir, n).createOrReplaceTempView(n)


def both(make: Callable[[str], str], *tables: str) -> tuple[Callable, str]:
    """A query and its twin from one text in either dialect."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables)
        return spark.sql(make(SPARK))

    return run, make(DUCK)

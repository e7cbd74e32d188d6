"""The smallest slice of the whole: profile a column, generate from the profile alone, profile again, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.operators import generate as G, profile as P
from tabloom.operators.validate import fidelity


def fidelity_of_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fidelity of orders' status and of its customer key, generated at the source's size."""
    source = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", "o_custkey")
    columns = source.columns
    base = P.basics(source, columns).join(P.ndistinct(source, columns), "col")
    mcv = P.most_common(source, columns)
    rows = base.collect()
    n = rows[0]["row_count"] if rows else 0
    made = {}
    for c, kind in (("o_orderstatus", "string"), ("o_custkey", "bigint")):
        own = next(r for r in rows if r["col"] == c)
        common = [(r["value"] if kind == "string" else int(r["value"]), r["freq"]) for r in mcv.where(F.col("col") == c).orderBy("rank").collect()]
        bounds = [] if kind == "string" else [r["bound"] for r in P.histogram(source, c).orderBy("i").collect()]
        made[c] = (G.Stats(c, own["null_percent"] / 100, common, bounds, own["ndistinct"]), kind)
    again = G.normal_columns(spark.range(n), made, "orders")
    return fidelity(base, P.basics(again, columns).join(P.ndistinct(again, columns), "col"))

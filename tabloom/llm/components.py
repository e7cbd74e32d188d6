"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabloom.llm._common import joined, stored


def _with_min(directed: DataFrame, name: str) -> DataFrame:
    """(u, v, m): each edge with the smallest node among u and its neighbours. The minimum is aggregated map-side first
    and joined back: that of a hub, which holds many of the edges, by broadcast, so that its neighbours stay apart."""
    low = stored(directed.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("joined_n")), name)
    return joined(directed, low.select("u", F.least("u", "m").alias("m")), ["u"], counts=low.select("u", "joined_n"))


def components(edges: DataFrame, name: str, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges (u, v), of any ordered type; root is the smallest node of its component.
    Nodes without an edge have no row; an empty edge table gives an empty result. Each round is written to the shared
    folder, which cuts the lineage and survives lost executors; repeated rows and self-loops change nothing."""
    flipped = lambda e: e.select(F.col("v").alias("u"), F.col("u").alias("v"))
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(flipped(now))
        large = _with_min(both, f"{name}-least").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), f"{name}-large")
        own = _with_min(large, f"{name}-least")  # here u > v always: v are all the smaller neighbours
        small = own.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), name)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

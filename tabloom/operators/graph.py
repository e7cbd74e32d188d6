"""Dependencies between tables: foreign-key edges as a small DataFrame, or on the driver as pairs of names."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

Edge = tuple[str, str]  # child, parent


def components(tables: list[str], edges: list[Edge]) -> dict[str, str]:
    """Of each table the first name of its weakly connected component."""
    up = {t: t for t in tables}

    def find(t: str) -> str:
        while up[t] != t:
            t = up[t]
        return t

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {t: find(t) for t in tables}


def levels(tables: list[str], edges: list[Edge], nullable: set[Edge] = frozenset()) -> tuple[dict[str, int], set[Edge]]:
    """Of each table its level: 0 without parents, else one more than its highest parent; and the edges that were left
    out to break cycles (self-references and edges whose child column may be null). A cycle of other edges is an error:
    its tables can't be filled."""
    left_out = {e for e in edges if e[0] == e[1]}
    while True:
        parents = defaultdict(set)
        for child, parent in set(edges) - left_out:
            parents[child].add(parent)
        level: dict[str, int] = {}
        todo = set(tables)
        while ready := {t for t in todo if parents[t] <= level.keys()}:
            level |= {t: 1 + max((level[p] for p in parents[t]), default=-1) for t in ready}
            todo -= ready
        if not todo:
            return level, left_out
        breakable = sorted(e for e in set(edges) - left_out if e[0] in todo and e[1] in todo and e in nullable)
        if not breakable:
            raise ValueError(f"foreign keys form a cycle among {sorted(todo)}")
        left_out.add(breakable[0])


def levels_frame(spark: SparkSession, edges: DataFrame, tables: DataFrame) -> DataFrame:
    """(tab, level) by a recursive query over edges (tab, ref) without cycles."""
    edges.select("tab", "ref").distinct().createOrReplaceTempView("graph_edges")
    tables.select("tab").distinct().createOrReplaceTempView("graph_tables")
    return spark.sql("""with recursive up(tab, level) as (
      select tab, 0 from graph_tables union all select e.tab, up.level + 1 from up join graph_edges e on e.ref = up.tab)
      select tab, max(level) as level from up group by tab""")


def mandatory(column: str, referencing: dict[str, list[str]], mcv: dict[str, list]) -> list:
    """Values that a column must hold: the most common values of all columns that refer to it, directly or through
    others; each column is visited once."""
    seen, todo, out = set(), [column], set()
    while todo:
        c = todo.pop()
        for child in referencing.get(c, []):
            if child not in seen:
                seen.add(child)
                out |= set(mcv.get(child, []))
                todo.append(child)
    return sorted(out)

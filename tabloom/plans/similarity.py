"""Comparison of query plans: a weighted tree edit distance and what it says in percent."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame

#: Weights of plan nodes; any other node weighs 1.
WEIGHTS = {
    "Seq Scan": 2.0,
    "Index Scan": 1.5,
    "Index Only Scan": 1.2,
    "Hash Join": 3.5,
    "Merge Join": 3.5,
    "Nested Loop": 2.5,
    "Memoize": 2.5,
    "Hash": 3.5,
    "Merge": 3.5,
    "Aggregate": 1.0,
    "Sort": 0.5,
    "Gather": 2.5,
}
#: What Spark's operators are called there.
SPARK_NODES = {
    "FileSourceScan": "Seq Scan",
    "RowDataSourceScan": "Seq Scan",
    "RDDScan": "Seq Scan",
    "InMemoryTableScan": "Seq Scan",
    "BatchScan": "Seq Scan",
    "LocalTableScan": "Seq Scan",
    "Range": "Seq Scan",
    "BroadcastHashJoin": "Hash Join",
    "ShuffledHashJoin": "Hash Join",
    "SortMergeJoin": "Merge Join",
    "BroadcastNestedLoopJoin": "Nested Loop",
    "CartesianProduct": "Nested Loop",
    "HashAggregate": "Aggregate",
    "ObjectHashAggregate": "Aggregate",
    "SortAggregate": "Aggregate",
    "Sort": "Sort",
    "ShuffleExchange": "Gather",
    "BroadcastExchange": "Hash",
}


@dataclass(frozen=True)
class Node:
    kind: str
    relation: str | None = None
    index: str | None = None
    side: str | None = None
    children: tuple[Node, ...] = field(default=())


def parse(text: str) -> Node | None:
    """The tree of an EXPLAIN in JSON: an array of one plan, or one object; null where there is none."""
    found = json.loads(text)
    if isinstance(found, list):
        found = found[0] if found else None
    return _node(found["Plan"]) if found and "Plan" in found else None


def _node(p: dict) -> Node:
    return Node(p.get("Node Type", ""), p.get("Relation Name"), p.get("Index Name"), p.get("Parent Relationship"), tuple(map(_node, p.get("Plans", []))))


def of_query(df: DataFrame) -> Node | None:
    """The tree of a DataFrame's physical plan before it is adapted at run time; operators without a counterpart give
    way to their children."""

    def walk(p) -> list[Node]:
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.initialPlan())
        kids = p.children()
        below = [n for i in range(kids.size()) for n in walk(kids.apply(i))]
        kind = SPARK_NODES.get(name.removesuffix("Exec"))
        if kind is None:
            return below
        relation = None
        if name == "FileSourceScanExec":
            paths = p.relation().location().rootPaths()
            relation = paths.head().getName().removesuffix(".parquet") if paths.size() else None
        return [Node(kind, relation, None, None, tuple(below))]

    found = walk(df._jdf.queryExecution().executedPlan())
    return found[0] if found else None


def count(n: Node | None) -> int:
    return 0 if n is None else 1 + sum(map(count, n.children))


@cache
def weight(n: Node | None) -> float:
    """Of a whole subtree, which is what inserting or deleting it costs."""
    return 0.0 if n is None else WEIGHTS.get(n.kind, 1.0) + sum(map(weight, n.children))


def replace_cost(a: Node, b: Node) -> float:
    """Of one node by another, without their children: nothing if all fields agree; for one kind 0.4 if relation or
    index differ and 0.2 if the side does; else 0.4 of both weights."""
    if a.kind != b.kind:
        return 0.4 * (WEIGHTS.get(a.kind, 1.0) + WEIGHTS.get(b.kind, 1.0))
    return 0.4 * ((a.relation, a.index) != (b.relation, b.index)) + 0.2 * (a.side != b.side)


@cache
def _forest(a: tuple[Node, ...], b: tuple[Node, ...]) -> float:
    """Cheapest alignment of two ordered sequences of subtrees."""
    row = [sum(map(weight, b[:j])) for j in range(len(b) + 1)]
    for x in a:
        last, row = row, [row[0] + weight(x)]
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + weight(x), row[j] + weight(y), last[j] + replace_cost(x, y) + _forest(x.children, y.children)))
    return row[-1]


def distance(a: Node | None, b: Node | None) -> float:
    return _forest(() if a is None else (a,), () if b is None else (b,))


def similarity(a: Node | None, b: Node | None) -> float:
    """0 to 100; two empty plans are alike."""
    most = max(weight(a), weight(b))
    return 100.0 if not most else max(0.0, min(100.0, (1 - distance(a, b) / most) * 100))

"""Whole tables from the two exported files: statistics of columns and constraints, as text.

A column is an SQL expression of the row's number, chosen by its type and its statistics; keys are distinct by
construction, foreign keys are ranks of the parents made before. Tables come level by level, each validated."""

from __future__ import annotations

import datetime
import re
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.functions import values as V
from tabloom.functions.pgtext import parse_array
from tabloom.functions.prng import SPARK, permuted, uniform
from tabloom.operators import engine, generate as G, graph
from tabloom.operators.profile import checkpointed
from tabloom.sources import ddl

#: Parents of so many keys at most are broadcast to their children's rows.
BROADCAST = 500_000


@dataclass(frozen=True)
class Column:
    """A line of the statistics file. mcv: (text, share of all rows); refs: (table, column) with the kind of each."""

    table: str
    name: str
    kind: str
    rows: int
    null_frac: float = 0.0
    mcv: list[tuple[str, float]] = field(default_factory=list)
    bounds: list[str] = field(default_factory=list)
    ndistinct: float = -1.0
    width: float = 8.0
    most: int = -1
    flags: frozenset = frozenset()
    refs: list[tuple[str, str]] = field(default_factory=list)
    relations: list[str] = field(default_factory=list)


def read_stats(lines: DataFrame) -> list[Column]:
    """Columns from a statistics file as artifacts.read_csv gives it: one row a column, so bounded by the schema."""
    out = []
    for r in (x.asDict() for x in lines.collect()):
        values, shares = parse_array(r["mcv"]) or [], [float(x) for x in parse_array(r["mcv_frequencies"]) or []]
        flags = frozenset(w for w in ("PRIMARY KEY", "FOREIGN KEY", "UNIQUE", "CHECK") if w in (r["modifiers"] or ""))
        refs = [tuple(x.strip().split(".")[-2:]) for x in (r["outcoming_references"] or "").split(",") if x.strip()]
        relations = [x.strip() for x in (r["relation_types"] or "").split(",") if x.strip()]
        out.append(Column(r["table_name"], r["column_name"], r["data_type"], int(float(r["row_count"])), float(r["null_percent"]) / 100, list(zip(values, shares, strict=True)), parse_array(r["hbounds"]) or [], float(r["ndistinct"]), float(r["avg_column_width_bytes"]), int(float(r["max_length"])), flags, refs, relations))
    return out


def read_keys(lines: DataFrame) -> dict[str, list[list[str]]]:
    """Of each table its primary and unique keys, from a constraints file."""
    out = defaultdict(list)
    for r in sorted((x.asDict() for x in lines.collect()), key=lambda r: (r["type"], r["constraint_name"])):
        if r["type"] in ("PRIMARY KEY", "UNIQUE"):
            names = [x.strip().split(".") for x in r["columns"].split(",")]
            out[names[0][-2]].append([x[-1] for x in names])
    return dict(out)


def _micros(text: str) -> int:
    t = datetime.datetime.fromisoformat(re.sub(r"([+-]\d\d)$", r"\1:00", text.strip()))
    t = t if t.tzinfo else t.replace(tzinfo=datetime.timezone.utc)
    return (t - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) // datetime.timedelta(microseconds=1)


def _days(text: str) -> int:
    return (datetime.date.fromisoformat(text.strip()[:10]) - datetime.date(1970, 1, 1)).days


def _seconds(text: str) -> int:
    h, m, s = text.strip().split(":")
    return int(h) * 3600 + int(m) * 60 + int(float(s))


def _is_text(kind: str) -> bool:
    return ddl.spark_type(kind) == "string" and kind not in ("json", "jsonb", "interval")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _text_place(d: str, c: Column, row: str, table: str):
    """place() of generate.normal for text: the common start of a bucket's bounds, one character strictly between the
    next ones (the left one if they are neighbours), and random characters up to the mean width."""
    most = c.most if c.most > 0 else max(1, round(c.width))
    starts, lows, gaps = [], [], []
    for left, right in zip(c.bounds, c.bounds[1:]):
        n = next((i for i, (a, b) in enumerate(zip(left, right)) if a != b), min(len(left), len(right)))
        a, b = ord(left[n]) if n < len(left) else 32, ord(right[n]) if n < len(right) else 126
        starts.append(left if left == right else left[:n])
        lows.append(0 if left == right else a)
        gaps.append(max(0, b - a - 1))
    arrays = G.array(d, starts, "string" if d == SPARK else "varchar"), G.array(d, lows, "int"), G.array(d, gaps, "int")
    size = max(0, min(most, round(c.width)))

    def place(bucket: str, salt: int) -> str:
        start, low, gap = (G.at(d, x, bucket) for x in arrays)
        u = uniform(d, table, c.name, row, salt)
        char = f"case when {low} = 0 then '' when {gap} = 0 then chr({low}) else chr(cast({low} + 1 + floor({u} * {gap}) as int)) end"
        whole = f"concat({start}, {char})"
        pad = f"case when {low} = 0 then '' else substr({V.text(d, row, f'{table}.{c.name}.{salt}', max(1, size))}, 1, cast(greatest(0, {size} - length({whole})) as int)) end"
        return f"substr(concat({whole}, {pad}), 1, {most})"

    return place


def expression(d: str, c: Column, row: str, salt: int = 0, r: str | None = None) -> str:
    """SQL for a column's values in either dialect, from nulls, most common values, bounds and the type's own generator.
    An array has one element; what the type's generator gives as text stays text. r names a column that already holds
    first_draw(), which the expression needs several times."""
    table, kind = f"{c.table}.{salt}", c.kind.lower()
    if kind.endswith("[]"):
        element = expression(d, Column(c.table, c.name, kind[:-2], c.rows), row, salt)
        value = f"array({element})" if d == SPARK else f"[{element}]"
        return f"case when {uniform(d, table, c.name + '-null', row)} < {c.null_frac!r} then null else {value} end" if c.null_frac else value
    name, type_ = f"{table}.{c.name}", ddl.spark_type(kind)

    def of(parse, spark: str, free: str, place=None, bounds: bool = True) -> str:
        s = G.Stats(c.name, c.null_frac, [(parse(v), f) for v, f in c.mcv], [parse(b) for b in c.bounds] if bounds else [], c.ndistinct)
        return G.normal(d, s, spark, row, table, r, place(s) if place else None, free)

    if kind.startswith("time") and not kind.startswith("timestamp"):
        seconds = f"cast({of(_seconds, 'bigint', V.seconds_of_day(d, row, name))} as bigint)"
        return V.clock(d, seconds) if "with time zone" not in kind and kind != "timetz" else f"concat({V.clock(d, seconds)}, '+00')"
    if type_ in ("smallint", "int", "bigint"):
        top = {"smallint": 1 << 15, "int": 1 << 31, "bigint": 1 << 62}[type_]
        return f"cast({of(lambda x: int(float(x)), 'bigint', V.integer(d, row, name, 0, top, 'bigint'))} as {type_ if d == SPARK else kind})"
    if type_ in ("float", "double"):
        digits = 6 if type_ == "float" else 15

        def between(s: G.Stats):
            bounds = G.array(d, s.bounds, "double")
            return lambda b, k: f"round({G.at(d, bounds, b)} + {uniform(d, table, c.name, row, k)} * ({G.at(d, bounds, f'{b} + 1')} - {G.at(d, bounds, b)}), {min(digits, 9)})"

        return f"cast({of(float, 'double', V.floating(d, row, name, 0.0, 1000.0, min(digits, 9)), between)} as {type_})"
    if type_.startswith("decimal"):
        p, s = map(int, re.findall(r"\d+", type_))
        unit = lambda x: round(float(x) * 10**s)
        units = of(unit, "bigint", V.integer(d, row, name, 0, min(10**p, 1 << 52), "bigint"))
        return f"cast(cast({units} as decimal({'20' if d == SPARK else '38'}, 0)) / {10**s} as decimal({p}, {s}))"
    if type_ in ("timestamp", "timestamp_ntz"):
        at = of(_micros, "bigint", V.integer(d, row, name, 0, 4_102_444_800_000_000, "bigint"))
        return f"cast(timestamp_micros({at}) as timestamp_ntz)" if d == SPARK else f"make_timestamp({at})"
    if type_ == "date":
        at = of(_days, "bigint", V.integer(d, row, name, 0, 47_482, "bigint"))
        return f"date_add(date'1970-01-01', cast({at} as int))" if d == SPARK else f"cast(date'1970-01-01' + cast({at} as int) as date)"
    text = "string" if d == SPARK else "varchar"
    free = {
        "boolean": lambda: f"cast({V.boolean(d, row, name)} as {text})",
        "binary": lambda: V.bytea(d, row, name, max(1, round(c.width))),
        "interval": lambda: V.interval(d, row, name),
        "point": lambda: V.point(d, row, name),
        "json": lambda: V.json(d, row, name),
    }.get({"boolean": "boolean", "bool": "boolean", "bytea": "binary", "interval": "interval", "point": "point", "json": "json", "jsonb": "json"}.get(kind, ""), None)
    if free:
        value = of(str, text, free(), bounds=False)
        return f"cast({value} as boolean)" if type_ == "boolean" else value
    if kind == "tstzrange":
        return of(str, text, f"concat('[', cast({V.time_range(d, row, name)[0]} as {text}), ',', cast({V.time_range(d, row, name)[1]} as {text}), ')')", bounds=False)
    size = c.most if 0 < c.most < c.width else max(1, round(c.width))
    return of(str, text, V.text(d, row, name, size), lambda s: _text_place(d, c, row, table))


def first_draw(d: str, c: Column, row: str, salt: int = 0) -> str:
    """The number that decides between null, a common value and a bucket in expression()."""
    return uniform(d, f"{c.table}.{salt}", c.name, row)


def distinct(d: str, c: Column, row: str, must: list[str]) -> str:
    """SQL for values that differ by construction: first the values that other columns need and that would not come by
    themselves, then integers upward from the first bound, or texts that end with the row's number."""
    if ddl.spark_type(c.kind) in ("smallint", "int", "bigint"):
        known = [int(float(x)) for x in (*c.bounds[:1], *(v for v, _ in c.mcv))]
        lo, wanted = min(known, default=1), sorted({int(float(x)) for x in must})
        own = [x for x in wanted if not lo <= x < lo + c.rows - len(wanted)]
        value = f"{lo} + {row} - {len(own)}"
        if own:
            value = f"case when {row} < {len(own)} then {G.at(d, G.array(d, own, 'bigint'), f'least({row}, {len(own) - 1})')} else {value} end"
        return f"cast({value} as {ddl.spark_type(c.kind) if d == SPARK else c.kind})"
    wanted = sorted(set(must))
    value = V.distinct_text(d, f"cast({row} as bigint)", f"{c.table}.{c.name}", max(7, c.most if 0 < c.most < c.width else round(c.width)))
    if not wanted:
        return value
    return f"case when {row} < {len(wanted)} then {G.at(d, G.array(d, wanted, 'string' if d == SPARK else 'varchar'), f'least({row}, {len(wanted) - 1})')} else {value} end"


def _maker(columns: list[Column], single: set[str], needed: dict[str, list[str]]) -> engine.Maker:
    """Rows of a table. Each column by its strategy: unique, foreign key or normal."""

    def make(spark: SparkSession, first: int, rows: int, salt: int, parents: dict[str, DataFrame]) -> DataFrame:
        out, ranks, joins, draws = [], [], [], []
        for c in columns:
            strategy = G.strategy(c.name in single, False, bool(c.refs), c.ndistinct if not c.refs and _distinct_by_itself(c) else 0.0)
            if c.refs and c.refs[0][0] != c.table:
                parent, ref = c.refs[0]
                keys = G.common_keys([(parents[p], [r]) for p, r in c.refs if p in parents], [f"key_{c.name}"])
                places = checkpointed(G.ranked(keys, [f"key_{c.name}"]))
                m = places.count()
                if not m:
                    raise ValueError(f"{parent} has no key for {c.table}.{c.name}")
                if strategy == "unique":
                    if m < c.rows:
                        raise ValueError(f"{m} keys of {parent} can't serve {c.rows} rows of {c.table}")
                    rank = permuted("row_id", m)
                else:
                    kind = ddl.spark_type(c.kind)
                    common = [(int(float(v)) if kind in ("smallint", "int", "bigint") else v, f) for v, f in c.mcv]
                    rank = G.parent_rank(places, m, [f"key_{c.name}"], "row_id", c.null_frac, common, f"{c.table}.{c.name}", salt)
                ranks.append(f"cast({rank} as bigint) as rank_{c.name}")
                joins.append((c.name, F.broadcast(places) if m <= BROADCAST else places))
                out.append(f"key_{c.name} as {c.name}")
            elif strategy == "unique" or c.refs:
                out.append(f"{distinct(SPARK, c, 'row_id', needed.get(c.name, []))} as {c.name}")
            else:
                draws.append(f"{first_draw(SPARK, c, 'row_id', salt)} as draw_{c.name}")
                out.append(f"{expression(SPARK, c, 'row_id', salt, f'draw_{c.name}')} as {c.name}")
        df = spark.range(first, first + rows).withColumnRenamed("id", "row_id").selectExpr("row_id", *ranks)
        for name, places in joins:
            df = df.join(places.withColumnRenamed("rank", f"rank_{name}"), f"rank_{name}", "left")
        return df.selectExpr("*", *draws).selectExpr("row_id", *out)

    return make


def _distinct_by_itself(c: Column) -> bool:
    """Whether a column without a key that has no two equal values can be made so: integers and texts."""
    return not c.mcv and (ddl.spark_type(c.kind) in ("smallint", "int", "bigint") or _is_text(c.kind))


def plan(columns: list[Column], keys: dict[str, list[list[str]]]) -> tuple[dict, list[graph.Edge], set[graph.Edge]]:
    """What engine.generate takes: of each table rows, maker and rules; edges; and those of them that may be null."""
    tables = defaultdict(list)
    for c in columns:
        tables[c.table].append(c)
    referencing, common = defaultdict(list), {}
    for c in columns:
        common[f"{c.table}.{c.name}"] = [v for v, _ in c.mcv]
        for t, r in c.refs:
            referencing[f"{t}.{r}"].append(f"{c.table}.{c.name}")
    out = {}
    for t, own in tables.items():
        of = keys.get(t, [])
        single = {k[0] for k in of if len(k) == 1}
        needed = {c.name: graph.mandatory(f"{t}.{c.name}", referencing, common) for c in own}
        whole = [c.name for c in own if "PRIMARY KEY" in c.flags]
        refs = [(c.name, p, r) for c in own for p, r in c.refs if p != t and p in tables]

        def rules(made: dict[str, DataFrame], of=of, whole=whole, refs=refs) -> dict:
            return {"not_null": whole, "keys": of, "parents": [([n], made[p], [r]) for n, p, r in refs]}

        out[t] = (own[0].rows, _maker([c if all(p in tables for p, _ in c.refs) else Column(**{**vars(c), "refs": []}) for c in own], single, needed), rules)
    edges = [(c.table, t) for c in columns for t, _ in c.refs if t in tables]
    return out, edges, {(c.table, t) for c in columns for t, _ in c.refs if c.null_frac > 0}


def generate(spark: SparkSession, stats: DataFrame, constraints: DataFrame) -> dict[str, DataFrame]:
    """All tables of a statistics file, with the keys of a constraints file. References to tables that the statistics
    don't have are left out."""
    return engine.generate(spark, *plan(read_stats(stats), read_keys(constraints)))

"""Stat-driven generation: every column is an expression of the row's number, so that rows need neither state nor
order and any partition can be made again.

Pools (most common values, bounds) are array literals; parents of foreign keys are ranked tables joined by rank."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabloom.functions.prng import SPARK, below, integer_division, permuted, uniform
from tabloom.operators.profile import checkpointed


@dataclass(frozen=True)
class Stats:
    """What a column is generated from. mcv: (value, share of all rows) by falling share; bounds: of equally deep
    buckets; null_frac from 0 to 1; ndistinct in the signed convention."""

    name: str
    null_frac: float = 0.0
    mcv: list[tuple] = field(default_factory=list)
    bounds: list = field(default_factory=list)
    ndistinct: float = -1.0


def strategy(is_pk: bool, is_unique: bool, is_fk: bool, ndistinct: float) -> str:
    """unique before foreign key before normal."""
    return "unique" if is_pk or is_unique or ndistinct == -1 else "foreign key" if is_fk else "normal"


def array(d: str, items: list, kind: str) -> str:
    cell = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    body = ", ".join(map(cell, items))
    return f"cast(array({body}) as array<{kind}>)" if d == SPARK else f"cast([{body}] as {kind}[])"


def at(d: str, values: str, i: str) -> str:
    """Element i (from 0) of an array expression."""
    return f"element_at({values}, cast({i} as int) + 1)" if d == SPARK else f"({values})[cast({i} as int) + 1]"


def alias_table(weights: list[float]) -> tuple[list[float], list[int]]:
    """Walker's alias table: of n equally likely cells, the share that is the cell's own, and what the rest stands for."""
    n, total = len(weights), sum(weights)
    share, other = [w * n / total for w in weights], list(range(n))
    low = [i for i, x in enumerate(share) if x < 1]
    high = [i for i, x in enumerate(share) if x >= 1]
    while low and high:
        a, b = low.pop(), high[-1]
        other[a] = b
        share[b] -= 1 - share[a]
        if share[b] < 1:
            low.append(high.pop())
    return [round(min(1.0, x), 12) for x in share], other


def picked(d: str, values: list, weights: list[float], kind: str, u: str) -> str:
    """A value by its weight from a uniform number u, in constant time: one cell of the alias table is looked at."""
    n = len(values)
    if n < 2:
        return at(d, array(d, values, kind), "0")
    share, other = alias_table(weights)
    cell = f"least({n - 1}, cast(floor({u} * {n}) as int))"
    shares, others = array(d, [repr(x) for x in share], "double").replace("'", ""), array(d, other, "int")
    own = f"({u} * {n} - {cell} < {at(d, shares, cell)})"
    return at(d, array(d, values, kind), f"case when {own} then {cell} else {at(d, others, cell)} end")


def normal(d: str, s: Stats, kind: str, row: str, table: str = "t", r: str | None = None, place=None, free: str | None = None) -> str:
    """One uniform number decides between null, a most common value and a bucket; a second one is the place within the
    bucket. The bucket is found by arithmetic, the common value by an alias table, and equal bounds give the bound.

    place(bucket, salt) is a value of a bucket (by number), of integers by default; free is a value for all mass that
    neither nulls, common values nor buckets have. A value within a bucket that is a most common one is drawn again, four
    times at most. r names a column that already holds the first number, which the expression needs several times."""
    r = r or uniform(d, table, s.name, row)
    edge = s.null_frac + sum(f for _, f in s.mcv)
    parts = [f"when {r} < {s.null_frac!r} then null"] if s.null_frac else []
    values = array(d, [v for v, _ in s.mcv], kind) if s.mcv else None
    if s.mcv:
        inner = f"(({r} - {s.null_frac!r}) / {edge - s.null_frac!r})"
        parts.append(f"when {r} < {edge!r} then {picked(d, [v for v, _ in s.mcv], [f for _, f in s.mcv], kind, inner)}")
    n = len(s.bounds) - 1
    if n < 1:
        last = free or (at(d, values, str(len(s.mcv) - 1)) if s.mcv else "null")
        return f"case {' '.join(parts)} else {last} end" if parts else last
    bucket = f"greatest(0, least({n - 1}, cast(floor(({r} - {edge!r}) / {max(1e-12, 1 - edge)!r} * {n}) as int)))"
    if place is None:
        bounds = array(d, s.bounds, kind)

        def place(b: str, salt: int) -> str:
            lo, hi = at(d, bounds, b), at(d, bounds, f"{b} + 1")
            return f"({lo} + cast(floor({uniform(d, table, s.name, row, salt)} * ({hi} - {lo})) as {kind}))"

    draws = [place(bucket, k) for k in (1, 2, 3, 4)] if s.mcv else [place(bucket, 1)]
    tried = draws[-1]
    for i, x in reversed(list(enumerate(draws[:-1]))):
        if d == SPARK:  # each draw is written once: as text within text they outgrow what can be compiled
            tried = f"element_at(transform(array({x}), tried_{i} -> case when not array_contains({values}, tried_{i}) then tried_{i} else {tried} end), 1)"
        else:
            tried = f"case when not list_contains({values}, {x}) then {x} else {tried} end"
    return f"case {' '.join(parts)} else {tried} end" if parts else tried


def normal_columns(rows: DataFrame, specs: dict[str, tuple[Stats, str]], table: str = "t") -> DataFrame:
    """rows' id and a column of each of specs (statistics, type); each draw is made once a row and column."""
    drawn = rows.selectExpr("id", *[f"{uniform(SPARK, table, s.name, 'id')} as draw_{c}" for c, (s, _) in specs.items()])
    return drawn.selectExpr("id", *[f"{normal(SPARK, s, kind, 'id', table, f'draw_{c}')} as {c}" for c, (s, kind) in specs.items()])


def quotas(s: Stats, n: int) -> tuple[int, list[int], list[int], list[int]]:
    """Exact counts for n rows: nulls, rows of each most common value, rows of each bucket, distinct values of each."""
    nulls = round(s.null_frac * n)
    common = [round(f * n) for _, f in s.mcv]
    buckets = max(0, len(s.bounds) - 1)
    rest = max(0, n - nulls - sum(common))
    share = lambda total: [total // buckets + (i < total % buckets) for i in range(buckets)]
    distinct = round(-s.ndistinct * n if s.ndistinct < 0 else s.ndistinct) - len(s.mcv) - (1 if nulls else 0)
    return nulls, common, share(rest), share(max(0, distinct))


def quota(d: str, s: Stats, n: int, kind: str, row: str) -> str:
    """Deterministic counts: rows 0 to n - 1 are null, then each most common value in turn, then the buckets' values
    spread evenly between their bounds."""
    nulls, common, depth, _ = quotas(s, n)
    edge, parts = nulls, [f"when {row} < {nulls} then null"] if nulls else []
    for (value, _), c in zip(s.mcv, common, strict=True):
        edge += c
        parts.append(f"when {row} < {edge} then {at(d, array(d, [value], kind), '0')}")
    for i, c in enumerate(depth):
        if c:
            lo, hi = s.bounds[i], s.bounds[i + 1]
            parts.append(f"when {row} < {edge + c} then cast({lo} + {integer_division(d, f'({row} - {edge}) * {hi - lo}', c)} as {kind})")
            edge += c
    return f"case {' '.join(parts)} end"


def unique_integers(spark: SparkSession, n: int, lo: int, must: list[int] = ()) -> DataFrame:
    """value: n distinct integers, the mandatory ones and then lo, lo + 1, ... upward, without a shuffle of rows."""
    must = sorted(set(must))[:n]
    literal = ", ".join(map(str, must))
    if not must:
        return spark.range(lo, lo + n).select(F.col("id").alias("value"))
    inside = sum(lo <= m < lo + n - len(must) for m in must)
    top = lo + n - len(must) + inside
    while (more := sum(lo <= m < top for m in must)) != inside:
        top, inside = top + more - inside, more
    fresh = spark.range(lo, top).select(F.col("id").alias("value")).where(f"value not in ({literal})")
    return spark.createDataFrame([(m,) for m in must], "value long").unionByName(fresh)


def pool_size(n: int, columns: int, ndistinct: float) -> int:
    """Distinct values a column of a composite key needs for n tuples."""
    return max(math.floor(1.2 * ndistinct), math.ceil((10 * n) ** (1 / columns) - 1e-9))


def pool_weights(mcv: list[tuple], size: int) -> list[float]:
    """Most common values keep their shares; the others of the pool share what is left."""
    rest = max(0.0, 1 - sum(f for _, f in mcv))
    others = max(0, size - len(mcv))
    return [f for _, f in mcv] + [rest / others] * others


def reweighted(weight: float, used: int, empty: int, common: bool) -> float:
    """A value's weight after `used` draws and `empty` rounds in vain."""
    return weight * 0.999 ** (used * (1 + 5 * empty)) * (0.5 ** min(20, empty) if common else 1.0)


def weighted(d: str, values: list, weights: list[float], kind: str, row: str, name: str, salt: int = 0) -> str:
    """A value by its weight."""
    return picked(d, values, weights, kind, uniform(d, "pool", name, row, salt))


def with_fresh(pool: list[int], weights: list[float], empty: int) -> tuple[list[int], list[float]]:
    """The pool after a round in vain: a tenth as many fresh values above its largest, sharing a tenth of the weight for
    each round that gave nothing."""
    more = max(1, len(pool) // 10)
    top, total = max(pool), sum(weights) * 0.1 * max(1, empty)
    return [*pool, *range(top + 1, top + 1 + more)], [*weights, *[total / more] * more]


def composite(spark: SparkSession, n: int, pools: dict[str, tuple[list, list[float], str]], must: DataFrame | None = None, rounds: int = 4, over: float = 1.5) -> DataFrame:
    """n distinct tuples over pools (values, weights, type): mandatory tuples first, then weighted draws, oversampled and
    deduplicated. A deficit is drawn again with another salt, values being reweighted by how often they were used; what
    is short after `rounds` rounds is filled from all combinations in mixed-radix order, an exact way while the pools
    allow n tuples at all. Tuples are cut to n by the rank of a hash over ranges, so that no task holds all of them."""
    names = list(pools)
    space = math.prod(len(v) for v, _, _ in pools.values())
    if space < n:
        raise ValueError(f"{space} combinations can't give {n} distinct tuples")
    got, have, empty = None, 0, 0
    if must is not None:
        got = checkpointed(_first(must.select(*names).distinct(), names, n))
        have = got.count()
    for salt in range(rounds):
        if have == n:
            break
        own = {c: (v, [reweighted(w, round(have * w / sum(ws)), empty, w == max(ws)) for w in ws] if salt else ws, k) for c, (v, ws, k) in pools.items()}
        drawn = spark.range(math.ceil((n - have) * over) + 8).selectExpr(*[f"{weighted(SPARK, v, w, k, 'id', c, salt)} as {c}" for c, (v, w, k) in own.items()]).distinct()
        if got is not None:
            drawn = drawn.join(got, names, "left_anti")
        fresh = _first(drawn, names, n - have)
        got = checkpointed(fresh if got is None else got.unionByName(fresh))
        now = got.count()
        empty, have = empty + (now == have), now
    if have < n:
        radix, parts = 1, []
        for c, (v, _, k) in pools.items():
            parts.append(f"{at(SPARK, array(SPARK, v, k), f'(id div {radix}) % {len(v)}')} as {c}")
            radix *= len(v)
        spare = spark.range(min(space, 2 * n)).selectExpr(*parts)
        got = got.unionByName(_first(spare.join(got, names, "left_anti"), names, n - have))
    return got


def _first(rows: DataFrame, names: list[str], n: int) -> DataFrame:
    """n of the distinct rows, or all: those of the smallest hash."""
    rows = checkpointed(rows.withColumn("first_hash", F.xxhash64(*names)))
    if rows.count() <= n:
        return rows.drop("first_hash")
    return ranked(rows, ["first_hash", *names]).where(F.col("rank") < n).select(*names)


def ranked(parent: DataFrame, keys: list[str]) -> DataFrame:
    """parent's distinct keys with their rank from 0, in key order: range-partitioned, each range offset by those before
    it, so that no task sorts all keys."""
    own = parent.select(*keys).distinct()
    parts = checkpointed(own.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part").agg(F.count("*").alias("own"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("ahead"))
    local = Window.partitionBy("part").orderBy(*keys)
    return parts.join(F.broadcast(offsets), "part").select(*keys, (F.col("ahead") + F.row_number().over(local) - 1).alias("rank"))


def common_keys(parents: list[tuple[DataFrame, list[str]]], names: list[str]) -> DataFrame:
    """Keys that all parents have, under the given names."""
    out = None
    for df, keys in parents:
        own = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).distinct()
        out = own if out is None else out.intersect(own)
    return out


def parent_rank(places: DataFrame, m: int, names: list[str], row: str, null_frac: float = 0.0, common: list[tuple] = (), table: str = "fk", salt: int = 0) -> str:
    """SQL for the rank of a row's parent among m ranked ones: null at null_frac, each of common (key, share) by its share
    if there is such a parent, else any, uniformly."""
    share = {}
    if common and len(names) == 1:
        wanted = places.sparkSession.createDataFrame([(k,) for k, _ in common], places.select(*names).schema)
        found = {r[0]: r[1] for r in places.join(F.broadcast(wanted), names).select(names[0], "rank").collect()}
        share = {found[k]: f for k, f in common if k in found}
    rest = below(SPARK, m, table, "parent", row, salt)
    r, edge = uniform(SPARK, table, "null", row, salt), null_frac + sum(share.values())
    parts = [f"when {r} < {null_frac!r} then null"] if null_frac else []
    if share:
        parts.append(f"when {r} < {edge!r} then {picked(SPARK, list(share), list(share.values()), 'bigint', f'(({r} - {null_frac!r}) / {edge - null_frac!r})')}")
    return f"case {' '.join(parts)} else {rest} end" if parts else rest


def one_to_many(spark: SparkSession, n: int, keys: DataFrame, names: list[str], null_frac: float = 0.0, table: str = "fk", common: list[tuple] = ()) -> DataFrame:
    """id and the names: a parent key for each row, by the shares of common keys, else uniformly; a single key is null at
    null_frac, a composite one never. Without a parent key it is an error."""
    places = checkpointed(ranked(keys, names))
    m = places.count()
    if not m:
        raise ValueError("no parent has a key")
    rank = parent_rank(places, m, names, "id", null_frac if len(names) == 1 else 0.0, common, table)
    return spark.range(n).selectExpr("id", f"{rank} as rank").join(places, "rank", "left").select("id", *names)


def one_to_one(spark: SparkSession, n: int, keys: DataFrame, names: list[str], null_frac: float = 0.0) -> DataFrame:
    """id and the names: a different parent key for each row, by a bijection of ranks; a single key is null at null_frac.
    Fewer keys than rows are an error."""
    places = checkpointed(ranked(keys, names))
    m = places.count()
    if m < n:
        raise ValueError(f"{m} parent keys can't serve {n} rows")
    rank = permuted("id", m)
    if null_frac and len(names) == 1:
        rank = f"case when {uniform(SPARK, 'fk', 'null', 'id')} < {null_frac!r} then null else {rank} end"
    return spark.range(n).selectExpr("id", f"{rank} as rank").join(places, "rank", "left").select("id", *names)


def related(spark: SparkSession, n: int, keys: DataFrame, names: list[str], kind: str, null_frac: float = 0.0, common: list[tuple] = ()) -> DataFrame:
    """Parent keys by the kind of relationship, of one column or several."""
    if kind == "ONE_TO_ONE":
        return one_to_one(spark, n, keys, names, null_frac)
    if kind == "ONE_TO_MANY":
        return one_to_many(spark, n, keys, names, null_frac, common=common)
    raise ValueError(f"no generator for {kind}")


def slice_of(table: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows lo to hi - 1 of a ranked table."""
    return table.where(F.col("rank").between(lo, hi - 1))

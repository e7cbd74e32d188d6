"""The files between profiling and generating: statistics and constraints as CSV, bound by their headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.sources import catalog, ddl

#: Columns of the two files, in order.
STATS = "table_schema table_name column_name data_type row_count null_percent modifiers incoming_references max_length outcoming_references relation_types mcv mcv_frequencies avg_column_width_bytes ndistinct hbounds".split()
CONSTRAINTS = ["constraint_name", "type", "columns"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header; NULL is null, doubled quotes are quotes; lines of nulls only go."""
    df = spark.read.option("header", True).option("escape", '"').option("nullValue", "NULL").option("ignoreLeadingWhiteSpace", True).option("multiLine", True).csv(path)
    return df.dropna("all")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "NULL").option("emptyValue", "").csv(path)


def stats_frame(spark: SparkSession, sf_dir: str, tables: list[str], k: int = 100) -> DataFrame:
    """STATS' columns for each column of the tables: catalog facts beside measured ones. A column's values are counted
    once, in their own type; all that is measured comes from the counts."""
    from tabloom.functions.pgtext import render_array
    from tabloom.operators import profile as P

    rows = []
    edges = [(t, catalog.column_of(t, key[0]), r, catalog.column_of(r, rk[0])) for _, kind, t, key, r, rk in catalog.CONSTRAINTS if kind == "f"]
    for t in tables:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        cols = [c for own, _, c, kind in catalog.attributes() if own == t and not kind.endswith("[]")]
        counts = {c: P.checkpointed(P.typed_counts(df, c)) for c in cols}
        base = {r["col"]: r for r in _union([P.facts(counts[c], c) for c in cols])}
        tops = [P.commonest(counts[c], k).select(F.lit(c).alias("col"), "value", "cnt", F.round(F.col("cnt") / F.lit(base[c]["row_count"]), 8).alias("freq")) for c in cols if c in base]
        common: dict[str, list] = {}
        for r in sorted(_union(tops), key=lambda r: (-r["cnt"], r["value"])):  # at most k rows a column
            common.setdefault(r["col"], []).append((r["value"], r["freq"]))
        bounds = _bounds({c: counts[c] for c in cols if c in base and base[c]["different"] > len(common.get(c, [])) + 1}, k)
        for own, num, c, kind in catalog.attributes():
            if own != t or c not in base:
                continue
            flags = {x for n, x, ct, key, _, _ in catalog.CONSTRAINTS if ct == t and num in key}
            out = [f"public.{r}.{rc}" for a, ac, r, rc in edges if (a, ac) == (t, c)]
            into = [f"public.{a}.{ac}" for a, ac, r, rc in edges if (r, rc) == (t, c)]
            b, mcv = base[c], common.get(c, [])
            modifiers = " ".join(w for f, w in (("p", "PRIMARY KEY"), ("f", "FOREIGN KEY"), ("u", "UNIQUE"), ("c", "CHECK")) if f in flags)
            one = "ONE_TO_ONE" if flags & {"p"} and sum(num in key for _, x, ct, key, _, _ in catalog.CONSTRAINTS if ct == t and x == "p" and len(key) == 1) else "ONE_TO_MANY"
            rows.append(("public", t, c, kind, str(b["row_count"]), str(b["null_percent"]), modifiers or None, ", ".join(into) or None, str(ddl.max_length(kind)), ", ".join(out) or None, ", ".join([one] * len(out)) or None, render_array([v for v, _ in mcv]) if mcv else None, "{" + ",".join(map(str, [f for _, f in mcv])) + "}" if mcv else None, str(b["avg_width"]), str(b["ndistinct"]), render_array(bounds.get(c))))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in STATS))


def _union(parts: list[DataFrame]) -> list:
    """The rows of all parts, by one job."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out.collect() if out is not None else []


def _bounds(counts: dict[str, DataFrame], k: int) -> dict[str, list[str]]:
    """Of each column the bounds of its histogram as text, where its most common values leave two values at least."""
    from tabloom.operators import profile as P

    parts = [P.bounds(own, P.BUCKETS, k).select(F.lit(c).alias("col"), "i", F.col("bound").cast("string").alias("bound")) for c, own in counts.items()]
    found: dict[str, list] = {}
    for r in sorted(_union(parts), key=lambda r: (r["col"], r["i"])):  # 101 rows a column
        found.setdefault(r["col"], []).append(r["bound"])
    return {c: b for c, b in found.items() if len(set(b)) > 1}


def constraints_frame(spark: SparkSession) -> DataFrame:
    words = {"p": "PRIMARY KEY", "u": "UNIQUE", "f": "FOREIGN KEY", "c": "CHECK"}
    rows = [(n, words[k], ", ".join(f"public.{t}.{catalog.column_of(t, i)}" for i in key)) for n, k, t, key, _, _ in catalog.CONSTRAINTS]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in CONSTRAINTS)).orderBy(F.split("columns", r"\.")[1], "type")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

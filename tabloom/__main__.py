"""python -m tabloom export FILE | generate FILE [--key value ...]: the two halves, each from a settings file.

Of an export `dbname` is the folder of the source's Parquet tables; of a generation it is the folder that gets them."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tabloom import api
from tabloom.operators import database, engine
from tabloom.sources import artifacts, catalog, config


def export(spark: SparkSession, file: str) -> list[str]:
    """Write each file that the settings name; what was written."""
    found = config.export_settings(file)
    query, source, out = config.query_text(found), found["dbname"], []
    for t in catalog.COLUMNS:
        if artifacts.exists(spark, f"{source}/{t}.parquet"):
            spark.read.parquet(f"{source}/{t}.parquet").createOrReplaceTempView(t)
    texts = {"schema-file": lambda: api.dump_schema(spark, query), "index-file": lambda: api.dump_layout(spark, query)}
    if query:
        texts |= {"explainfile": lambda: api.export_query_plan(spark, query), "explainfile-analyze": lambda: api.export_query_plan(spark, query, analyze=True)}
    for key, make in texts.items():
        if key in found:
            Path(found[key]).write_text(make() + "\n")
            out.append(found[key])
    for key, make in (("stats-file", lambda: api.dump_statistic(spark, source, query)), ("constr-file", lambda: artifacts.constraints_frame(spark))):
        if key in found:
            artifacts.write_csv(make(), found[key])
            out.append(found[key])
    return out


def generate(spark: SparkSession, file: str, arguments: dict[str, str]) -> list[str]:
    """Generate the tables of a statistics file and write them; their names."""
    s = config.merged(arguments, file)
    made = database.generate(spark, artifacts.read_csv(spark, s.stat_path), artifacts.read_csv(spark, s.constraint_file))
    engine.write({n: df for n, df in made.items()}, s.dbname, max(1, s.store_threads * s.table_threads * 4))
    return sorted(made)


def main(words: list[str]) -> None:
    if len(words) < 2 or words[0] not in ("export", "generate"):
        raise SystemExit(__doc__)
    spark = SparkSession.builder.appName("tabloom").getOrCreate()
    rest = words[2:]
    arguments = {k.removeprefix("--").replace("-", "_"): v for k, v in zip(rest[::2], rest[1::2], strict=True)}
    print("\n".join(export(spark, words[1]) if words[0] == "export" else generate(spark, words[1], arguments)))


if __name__ == "__main__":
    main(sys.argv[1:])

"""Every registered query of the engine's own operators against its SQL twin, at the smallest scale."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest
from tabloom import queries

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, (decimal.Decimal, datetime.date)):
        return str(x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0

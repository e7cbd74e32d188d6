"""One-to-one keys are drawn from all keys of a table."""

import pytest
from tabloom.queries import engine_queries as E

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, table, keys", [("gen20_fk_11", "supplier", ["s_suppkey"]), ("gen21_fk_11_comp", "lineitem", ["l_orderkey", "l_linenumber"])])
def test_parents_are_whole(spark, monkeypatch, name, table, keys):
    seen, make = [], E.G.one_to_one
    monkeypatch.setattr(E.G, "one_to_one", lambda s, n, parent, cols, *a, **b: seen.append(parent.count()) or make(s, n, parent, cols, *a, **b))
    (row,) = E.Q[name](spark, SF).collect()
    assert set(row) == ({50} if name == "gen20_fk_11" else {500})
    assert seen == [spark.read.parquet(f"{SF}/{table}.parquet").select(*keys).distinct().count()]

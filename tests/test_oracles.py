"""Every query against its SQL, run by another engine over the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from leafloom.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for name in os.listdir(data):
        c.execute(f"create view {name.split('.')[0]} as select * from '{data}/{name}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def shown(x) -> str:
        if x is None or x is pd.NA or x != x:
            return "null"
        return f"{float(x):.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, data, name):
    found = catalog.QUERIES[name](spark, data).toPandas()
    wanted = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_every_query_is_registered():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())

"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from presswork.plans import registry
from presswork.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in fixtures.BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    res = duck.execute(registry.oracles()[name])
    names = [c[0] for c in res.description]
    want = [tuple(_plain(r[names.index(c)]) for c in columns) for r in res.fetchall()]
    assert sorted(names) == columns and sorted(got, key=str) == sorted(want, key=str)

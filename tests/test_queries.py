"""Every query with an SQL twin against DuckDB on the smallest tables, and the entry point."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from scenova.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(df: pd.DataFrame) -> list:
    show = lambda v: "NULL" if v is None or v != v else f"{v:.8g}" if isinstance(v, float) else str(int(v)) if hasattr(v, "dtype") and v.dtype.kind in "iu" else str(v)
    return sorted(tuple(show(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    number = {c: "float64" for c in ours.columns if pd.api.types.is_numeric_dtype(ours[c]) and not pd.api.types.is_bool_dtype(ours[c])}
    assert plain(ours.astype(number)) == plain(theirs.astype({c: k for c, k in number.items()}))


def test_entry(spark):
    assert entry.entry(spark).count() == 12
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) <= set(entry.queries())

"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.registry.QUERIES]


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
            return None
        if isinstance(x, (bool, np.bool_)):
            return float(x)
        if isinstance(x, (int, float, np.number)):
            return round(float(x), 6)
        return str(pd.Timestamp(x)) if hasattr(x, "year") else str(x)

    rows = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted((tuple(map(value, r)) for r in rows.values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.toPandas()
    if name in entry.oracle_sql():
        want = duck.sql(entry.oracle_sql()[name]).df()
        assert sorted(rows.columns) == sorted(want.columns)
        assert plain(rows) == plain(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "total_dkk" in df.columns


def test_the_training_data_package_is_optional(monkeypatch):
    def missing(name):
        raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(entry, "import_module", missing)
    assert set(entry.queries()) == set(OWN) and set(entry.oracle_sql()) <= set(OWN)


def test_other_import_errors_are_not_hidden(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError("No module named 'numpy'", name="numpy")

    monkeypatch.setattr(entry, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()

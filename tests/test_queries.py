"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from mnemo import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REG = plans.load()


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda x: "NULL" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(REG.SQL))
def test_against_sql(spark, con, name):
    got, want = REG.QUERIES[name](spark, SF).toPandas(), con.execute(REG.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(REG.QUERIES) - set(REG.SQL)))
def test_runs(spark, name):
    assert REG.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

"""Registered queries against their oracle SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry_module

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df):
    import pandas as pd

    cell = lambda v: "~" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v).replace(" 00:00:00", "")
    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry_module.plans.oracle_sql()))
def test_query_matches_its_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = entry_module.queries()[name](spark, DATA).toPandas(), con.sql(entry_module.oracle_sql()[name]).df()
    assert canonical(got) == canonical(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(entry_module.plans.queries()) - set(entry_module.plans.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    assert entry_module.queries()[name](spark, DATA).count() >= 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0

"""Every registered query with SQL against DuckDB on the same files, as the driver compares them."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from runlens.plans import queries, skill_queries, text_queries  # noqa: F401  their import registers
from runlens.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    if pd.isna(v):
        return ""
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.number)):
        return str(int(v)) if v == int(v) else f"{v:.6f}"
    return str(v)


def canon(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = db.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)
    else:
        assert len(got) > 0

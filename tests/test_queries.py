"""Every query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lexloom.plans.catalog import ORACLE_SQL, QUERIES

#: Queries that may return nothing on the smallest tables.
MAY_BE_EMPTY = {"foreign_key_check", "cache_remove", "undominated", "team_pairs", "compatible_pairs"}  # team_pairs: ten suppliers, each of another nation


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, pd.Timestamp):
        v = v.item()
    if isinstance(v, float):
        return None if v != v else int(v) if v == int(v) else round(v, 6)
    return str(v) if isinstance(v, pd.Timestamp) else v


def rows(df):
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, oracle):
    made = QUERIES[name](spark, sf).toPandas()
    if name not in MAY_BE_EMPTY:
        assert len(made)
    if name in ORACLE_SQL:
        wanted = oracle.execute(ORACLE_SQL[name]).df()
        assert sorted(made.columns) == sorted(wanted.columns)
        assert rows(made) == rows(wanted)

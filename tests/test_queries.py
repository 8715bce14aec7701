"""Every query with SQL against it, at two sizes."""

import os

import duckdb
import pytest

from veilwork.plans import more  # noqa: F401
from veilwork.plans.queries import ORACLE_SQL, QUERIES

ROOT = "/root/testdata"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name, sf):
    con = duckdb.connect()
    for t in "customer supplier part orders lineitem events documents pages labels".split():
        path = f"{ROOT}/{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = QUERIES[name](spark, f"{ROOT}/{sf}")
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    key = lambda rows: sorted(str(r) for r in rows)
    at = [want.columns.index(c) for c in columns]
    got = key(tuple(r[c] for c in columns) for r in df.collect())
    assert got == key(tuple(r[i] for i in at) for r in want.fetchall())
    assert got or (name, sf) in EMPTY


#: Queries that have no rows at a size.
EMPTY: set[tuple[str, str]] = set()

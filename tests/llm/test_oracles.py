"""The corpus queries that SQL can express, against DuckDB; the others return a row for each document."""

import glob
import os

import duckdb
import pytest

from corrweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, sf_small):
    df = queries.QUERIES[name](spark, sf_small)
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for path in glob.glob(f"{sf_small}/*.parquet"):
            con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
        want = con.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert rows == sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=str)
    elif name != "op9_chunks":
        table = "pages" if name == "op4_urls" else "documents"
        assert len(rows) == spark.read.parquet(f"{sf_small}/{table}.parquet").count()

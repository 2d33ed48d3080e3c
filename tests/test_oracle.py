"""Every query with a SQL twin against DuckDB, values and types."""

import duckdb
import pandas as pd
import pytest
from conftest import DATA

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def run_sql(sf, sql):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/sf{sf}/{table}.parquet'")
    return connection.sql(sql).to_arrow_table()


def as_sorted_rows(table):
    columns = sorted(table.column_names)
    frame = pd.DataFrame({c: table.column(c).to_pylist() for c in columns}, dtype=object)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_matches_duckdb(spark, sf, name):
    ours = entry_points.queries()[name](spark, f"{DATA}/sf{sf}").toArrow()
    theirs = run_sql(sf, entry_points.oracle_sql()[name])
    types = [{f.name: str(f.type) for f in t.schema} for t in (ours, theirs)]
    assert types[0] == types[1]
    assert as_sorted_rows(ours) == as_sorted_rows(theirs)


def test_every_sql_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())

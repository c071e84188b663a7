"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

# Too few keys at this scale.
EMPTY = {"key_accuracy_filtered", "farthest_points_xyz", "farthest_points_yz"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def comparable(table):
    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    names = sorted(table.column_names)
    columns = [[text(v) for v in table.column(n).to_pylist()] for n in names]
    types = [str(table.schema.field(n).type).replace("large_", "") for n in names]
    return names, types, sorted(zip(*columns))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR).toArrow()
    want = duck.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert comparable(got) == comparable(want)
    assert got.num_rows > 0 or name in EMPTY


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r.frequency for r in rows] == sorted((r.frequency for r in rows), reverse=True)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

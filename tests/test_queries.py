import glob
import os

import duckdb
import pytest

from graphloom.plans import queries as own

from mini import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(values):
    return sorted(tuple(map(str, r)) for r in values)


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_oracle(spark, duck, name):
    df = own.queries()[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(own.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    assert rows(df.select(*columns).collect()) == rows(expected.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(own.queries()) == set(own.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["arity_guard", "dedup_canonical", "dedup_survivors", "ref_redirect"])
def test_null_texts(spark, tmp_path, name):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None), (5, "a\nb\nc\nd\ne"), (6, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in (1, 3, 4, 9)], "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    for table, df in (("documents", docs), ("labels", labels)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df = own.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    expected = con.sql(own.oracle_sql()[name]).select(*[f'"{c}"' for c in columns])
    assert rows(df.select(*columns).collect()) == rows(expected.fetchall())

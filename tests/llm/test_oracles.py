import glob
import os

import duckdb
import pytest

from graphloom.llm import queries

from llm_data import ODD, prose

SF = "/root/testdata/sf0.001"


def rows(values):
    return sorted(tuple(map(str, r)) for r in values)


def compare(spark, con, name, folder):
    df = queries.queries()[name](spark, folder)
    columns = sorted(df.columns)
    expected = con.sql(queries.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    assert rows(df.select(*columns).collect()) == rows(expected.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", ["op3_packing", "op4_mixing"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    compare(spark, con, name, SF)


def test_packing_oracle_on_odd_rows(spark, tmp_path):
    texts = [*ODD, *(prose(i, 1 + 7 * i) for i in range(25)), prose(1, 5000)]
    made = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, prose(9, 4)), (None, "a b c"), (None, None)]
    spark.createDataFrame(made, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    compare(spark, con, "op3_packing", str(tmp_path))

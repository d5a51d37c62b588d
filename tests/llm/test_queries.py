"""Registered queries: present, whole, and equal to their SQL."""
import duckdb
import pytest

import __spark_entry__ as E
from lethe.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) <= set(E.queries()) and "pipeline" in E.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE[name]).df()
    cols = sorted(want.columns)
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == cols
    by = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    assert by(got).equals(by(want))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("op11", "op12"))))
def test_a_row_for_each_input(spark, name):
    table = "embeddings" if name.startswith("op10") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    got = QUERIES[name](spark, SF).count()
    assert got == (n // 100 * 10 if table == "embeddings" else n) if not name.startswith("op8") else got >= n

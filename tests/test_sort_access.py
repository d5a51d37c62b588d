"""Every matching statement of the log is in sort_access, in order."""
import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as E
from lethe.operators.keyed import place_in_order
from lethe.registry.oracle_base import with_tables
from lethe.registry.q_discovery import ACCESSED_SQL

SF = "/root/testdata/sf0.001"
WHOLE_SQL = with_tables("px_query_log") + f"""
SELECT query_id, customer_email_accessed, row_number() OVER (ORDER BY start_time DESC, query_id DESC) AS place
FROM ({ACCESSED_SQL}) ORDER BY place"""


def test_sort_access_returns_the_whole_log_in_order(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("customer", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(WHOLE_SQL).fetchall()
    got = [(r["query_id"], r["customer_email_accessed"], r["place"]) for r in E.queries()["sort_access"](spark, SF).collect()]
    assert len(want) > 100 and got == want


def test_place_in_order_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
        rows = place_in_order(df, [F.col("v").desc()], "place").collect()
        assert sorted((r["place"], r["v"]) for r in rows) == [(i + 1, 4999 - i) for i in range(5000)]
        assert place_in_order(df.where("v < 0"), [F.col("v").desc()], "place").collect() == []
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)

"""Discovery and erasure over tables of the session catalog."""
import datetime as dt

from pyspark.sql import functions as F

from lethe.plans import discovery as D
from lethe.plans import erasure as X
from lethe.session import scratch_path
from lethe.sources.catalog import CatalogModel


def test_catalog_model_discovery_and_erasure(spark, fixtures):
    db = "lethe_catalog_test"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{scratch_path(spark, db)}'")
    for name in ("customers", "orders", "user_activities"):
        path = scratch_path(spark, name)
        fixtures[name].write.parquet(path)
        spark.sql(f"DROP TABLE IF EXISTS {db}.{name}")
        spark.sql(f"CREATE TABLE {db}.{name} USING parquet LOCATION '{path}'")
    model = CatalogModel(spark, [db])
    assert sorted(model.names()) == [f"{db}.customers", f"{db}.orders", f"{db}.user_activities"]
    subj = spark.createDataFrame([("liv.brandt@post.example",)], "customer_email string")
    found = D.discover_subjects(model, subj, databases=model.scope())
    got = {(r.schema_name, r.table_name, r.column_name): r.records_found for r in found.collect()}
    assert got == {(db.upper(), "CUSTOMERS", "EMAIL"): 1, (db.upper(), "ORDERS", "CUSTOMER_EMAIL"): 2,
                   (db.upper(), "USER_ACTIVITIES", "USER_EMAIL"): 3}
    planned = X.plan_erasure(model, subj, dt.date(2024, 3, 20), "s", databases=model.scope())
    assert {n: e["status"] for n, e in planned.items()} == {
        f"{db}.customers": "SUCCESS", f"{db}.orders": "SUCCESS", f"{db}.user_activities": "SUCCESS"}
    log = X.operation_log(planned, subj.withColumn("request_id", F.lit("R1")))
    assert {(r.target_table, r.records_affected) for r in log.collect()} == {
        ("CUSTOMERS", 1), ("USER_ACTIVITIES", 3)}  # her orders are held

"""The status rules on rows the derived tables do not have: NULL dates, flags and statuses, in both engines."""
import datetime as dt

import duckdb
from pyspark.sql import functions as F

from lethe.plans import views as V
from lethe.registry.q_views import COMPLIANT_SQL
from lethe.sources.derived import AS_OF
from lethe.sources.schemas import conform

FLAGS = (True, False, None)
DATES = (None, dt.date(2001, 7, 31), dt.date(2001, 8, 1), dt.date(2001, 9, 1), dt.date(2001, 9, 2))
STATES = (None, "SUBMITTED", "VALIDATED", "IN_PROGRESS", "COMPLETED", "REJECTED", "other")


def test_null_dates_flags_and_statuses(spark):
    people = [(f"C{i}", f"u{i}@x.example", m, a, g, d, False)
              for i, (m, a, g, d) in enumerate((m, a, g, d) for m in FLAGS for a in FLAGS for g in (None, dt.datetime(1999, 1, 1)) for d in DATES)]
    asked = [(f"R{i}", f"u{i}@x.example", s, dt.datetime(2001, 1, 1)) for i, s in enumerate(STATES)]
    customers = conform(spark.createDataFrame(people, "customer_id string, email string, consent_marketing boolean, consent_analytics boolean, "
                                                      "consent_given_date timestamp, data_retention_until date, is_deleted boolean"),
                        "customers", F.lit(None).cast("timestamp"))
    requests = conform(spark.createDataFrame(asked, "request_id string, customer_email string, status string, requested_at timestamp"),
                       "erasure_requests", F.lit(None).cast("timestamp"))
    cols = ["customer_id", "gdpr_status", "retention_status", "consent_status"]
    con = duckdb.connect()
    frames = {"px_customers": customers.toPandas(), "px_erasure_requests": requests.toPandas()}
    for name, frame in frames.items():
        # consent flags keep their NULLs: defaults belong to inserted rows only
        con.register(name + "_frame", frame.astype(object).where(frame.notna(), None))
        casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _types(customers if name == "px_customers" else requests))
        con.execute(f"CREATE TABLE {name} AS SELECT {casts} FROM {name}_frame")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({COMPLIANT_SQL}) ORDER BY 1").fetchall()
    got = sorted(tuple(r) for r in V.customers_compliant(customers, requests, AS_OF).select(*cols).collect())
    assert got == want and len(got) == len(people)
    assert {r[2] for r in got} == {"OVERDUE_FOR_DELETION", "DUE_FOR_DELETION_SOON", "WITHIN_RETENTION_PERIOD"}


def _types(df):
    kinds = {"string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "bigint": "BIGINT"}
    return [(c, kinds.get(t, "VARCHAR")) for c, t in df.dtypes]

"""Command line: the reference demo's commands, each one Spark job over a batch.

    python -m lethe discover  --data DIR --email a@x.org,b@y.org
    python -m lethe status    --data DIR --email a@x.org
    python -m lethe request   --data DIR --email a@x.org --reason WITHDRAWN_CONSENT
    python -m lethe scenario  --data DIR --email a@x.org [--store PATH]
    python -m lethe dashboard --data DIR
    python -m lethe requests  --data DIR --limit 10
    python -m lethe export    --data DIR --email a@x.org --out PATH

``--data`` is a folder of the driver tables (the compliance model is derived
from it); ``--as-of`` replaces the current date.  Output is printed with
``show`` (a bounded number of rows reaches the driver).
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import functions as F


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="lethe")
    ap.add_argument("command", choices=["discover", "status", "request", "scenario", "dashboard",
                                        "requests", "export"])
    ap.add_argument("--data", required=True)
    ap.add_argument("--email", default="")
    ap.add_argument("--reason", default="WITHDRAWN_CONSENT")
    ap.add_argument("--as-of", default="2001-08-01")
    ap.add_argument("--limit", type=int, default=10)
    ap.add_argument("--salt", default="change-me")
    ap.add_argument("--store", default=None, help="folder that keeps the tables between runs (shared storage)")
    ap.add_argument("--rows", type=int, default=50, help="rows to print")
    ap.add_argument("--json", action="store_true", help="status as one JSON object per subject")
    ap.add_argument("--out", default=None, help="new folder of the export's documents (shared storage)")
    a = ap.parse_args(argv)
    if a.command == "export" and not a.out:
        ap.error("export needs --out")

    from .plans import discovery as D, export as E, reports as R, requests as Q, scenario as SC
    from .session import build_session, release, scratch_mark
    from .sources.derived import ComplianceModel
    from .sources.state import StateFolder

    spark = build_session()
    mark = scratch_mark(spark)
    try:  # scratch holds e-mails of people to be erased: it goes, also when a command fails
        spark.sparkContext.setLogLevel("ERROR")
        model = ComplianceModel(spark, a.data)
        as_of = dt.date.fromisoformat(a.as_of)
        emails = [e.strip() for e in a.email.split(",") if e.strip()]
        subjects = spark.createDataFrame([(e,) for e in emails], "customer_email string")

        if a.command == "discover":
            out = D.sort_discovery(D.discover_subjects(model, subjects))
        elif a.command == "status":
            out = Q.subject_status(subjects, model["erasure_requests"], model["customers"])
            if a.json:
                out = Q.subject_status_object(out)
        elif a.command == "request":
            cand = subjects.select("customer_email", F.lit(a.reason).alias("erasure_reason"),
                                   F.lit(1).cast("long").alias("submission_seq"))
            out = Q.submit_requests(cand, model["customers"], model["erasure_requests"], as_of)
        elif a.command == "scenario":
            state = StateFolder(spark, a.store) if a.store else None
            out = SC.scenario_summary(SC.full_scenario(model, subjects, as_of, a.salt, state=state))
        elif a.command == "export":
            E.write_documents(E.export_documents(E.export_rows(model, subjects)), a.out)
            out = (E.read_documents(spark, a.out).groupBy("customer_email", "table_name")
                   .agg(F.sum("copies").alias("records")).orderBy("customer_email", "table_name"))
        elif a.command == "dashboard":
            out = R.dashboard(model["erasure_requests"], as_of)
        else:
            out = R.requests_topk(model["erasure_requests"], as_of, a.limit)
        out.show(a.rows, truncate=False)
    finally:
        release(spark, mark)


if __name__ == "__main__":
    main()

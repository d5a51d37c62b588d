"""The end-to-end erasure scenario for a batch of subjects.

Steps, as the reference's demo runs them for one e-mail: initial status,
discovery, submission, processing, third-party coordination, verification,
final status, dashboard.  Every step is a DataFrame plan over the whole
batch; the only driver work is composing them.  With a ``StateFolder`` every
table is read from it once it is kept there, and the run stages everything it
makes (erased tables, requests, operations, audit rows, notifications) and
commits it at its end: a run that dies before that changes nothing, one that
dies within the commit is completed by the next use of the folder.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import discovery as D
from . import erasure as X
from . import reports as R
from . import requests as Q
from ..session import materialize, scratch_path
from ..sources.state import StatefulModel, StateFolder


def _merge_requests(base: DataFrame, updates: DataFrame, cols: list[str]) -> DataFrame:
    """``base`` with ``cols`` replaced from ``updates`` where a request id matches."""
    u = updates.select(F.col("request_id").alias("__rid"), *[F.col(c).alias(f"__u_{c}") for c in cols])
    j = base.join(u, base["request_id"] == u["__rid"], "left")
    return j.select(*[F.when(F.col("__rid").isNotNull(), F.col(f"__u_{c}")).otherwise(F.col(c)).alias(c)
                      if c in cols else F.col(c) for c in base.columns])


def full_scenario(model, subjects: DataFrame, as_of: dt.date, salt: str,
                  reason: str = "WITHDRAWN_CONSENT", state: StateFolder | None = None,
                  databases: list[str] | None = None) -> dict[str, DataFrame]:
    """Run the eight steps; returns every intermediate result by name.

    ``databases`` are those searched and erased from, by default the fixed
    ones (a model of other databases passes its ``scope()``).  Each erased table is
    written once, by the job that also counts its rows: under the state, or without one
    in the shared checkpoint folder.  Verification searches what was written.  All
    results are written too and stay readable whatever later runs do."""
    if state is not None:
        state.begin()
        model = StatefulModel(model, state)
    kept = materialize
    out: dict[str, DataFrame] = {}
    subj = subjects.select("customer_email").where(F.col("customer_email").isNotNull()).distinct()
    requests = model["erasure_requests"]
    customers = model["customers"]
    out["status_before"] = kept(Q.subject_status(subj, requests, customers), "status")
    out["discovered"] = kept(D.discover_subjects(model, subj, databases=databases), "discovered")
    cand = subj.select("customer_email", F.lit(reason).alias("erasure_reason"),
                       F.lit(1).cast("long").alias("submission_seq"))
    out["submitted"] = materialize(Q.submit_requests(cand, customers, requests, as_of), "submitted")
    requests1 = requests.unionByName(Q.accepted_request_rows(out["submitted"], as_of))
    accepted = out["submitted"].where(F.col("outcome") == "ACCEPTED").select("request_id")
    out["plan"] = materialize(Q.process_plan(accepted, requests1, model["retention_policies"],
                                             customers, as_of), "plan")
    to_erase = X.subjects_to_erase(out["plan"])
    planned = X.plan_erasure(model, to_erase, as_of, salt, databases=databases,
                             write=state.next_path if state is not None else (lambda name: scratch_path(model.spark, f"next-{name}")),
                             state=state)
    # only tables the erasure rewrote change (failed and skipped ones stay)
    after = {name: e["table"] for name, e in planned.items() if e["status"] == "SUCCESS"}
    out["rows_by_table"] = {name: e["rows"] for name, e in planned.items() if e["status"] == "SUCCESS"}
    go = out["plan"].where(F.col("decision") == "IN_PROGRESS").select("request_id", "customer_email")
    out["operations"] = kept(X.operation_log(planned, go), "operations")
    # verification: every rewritten table's e-mail columns (the labelled ones, where there are labels) and keys
    try:
        labelled = X.scope_from_classification(model["data_classification"])
    except KeyError:
        labelled = None
    counts = X.verify_planned(planned, model, labelled, to_erase)
    out["verification"] = kept(X.verify_deletion(counts), "verification") if counts is not None else None
    requests2 = Q.apply_decisions(requests1, out["plan"], as_of)
    done = Q.complete_requests(requests2, out["operations"], as_of, go)
    requests3 = materialize(_merge_requests(requests2, done, ["status", "completed_at", "actual_completion_date",
                                                              "deletion_summary", "verification_hash"]), "requests")
    out["requests"] = requests3
    # a request whose processors an earlier run has notified is not notified again
    fresh = requests3
    if state is not None and state.has("third_party_notifications"):
        told = state.read("third_party_notifications").select("request_id").distinct()
        fresh = requests3.join(told, "request_id", "left_anti")
    out["notifications"] = kept(Q.coordinate_processors(subj, fresh, as_of), "notifications")
    completed_now = requests3.join(go.select("request_id"), "request_id", "left_semi")
    out["audit"] = kept(Q.audit_append(Q.workflow_audit_events(out["submitted"], completed_now,
                                                               out["notifications"], as_of)), "audit")
    customers = after.get("customers", customers)
    out["status_after"] = kept(Q.subject_status(subj, requests3, customers), "status-after")
    if state is not None:
        state.stage("erasure_requests", requests3)
        for name, key in (("erasure_operations", "operations"), ("workflow_audit", "audit"),
                          ("third_party_notifications", "notifications")):
            state.stage_append(name, out[key])
        state.commit([*after, "erasure_requests"])
    out["dashboard"] = R.dashboard(requests3, as_of)
    return out


def scenario_summary(steps: dict[str, DataFrame]) -> DataFrame:
    """One row per subject: what each step concluded."""
    s = steps["status_before"].select("customer_email",
                                      F.col("has_active_request").alias("active_before"))
    disc = (steps["discovered"].groupBy("customer_email")
            .agg(F.sum("records_found").cast("long").alias("records_discovered")))
    sub = steps["submitted"].select("customer_email", F.col("outcome").alias("submit_outcome"),
                                    "request_id")
    plan = steps["plan"].select("request_id", "decision")
    notif = (steps["notifications"].groupBy("customer_email")
             .agg(F.count(F.lit(1)).alias("notifications")))
    after = steps["status_after"].select("customer_email",
                                         F.col("deletion_completed").alias("completed_after"))
    j = (s.join(disc, "customer_email", "left").join(sub, "customer_email", "left")
         .join(plan, "request_id", "left").join(notif, "customer_email", "left")
         .join(after, "customer_email", "left"))
    verification = F.lit("NOT_ERASED")
    if steps.get("verification") is not None:
        ver = X.verify_all(steps["verification"]).select("customer_email", "all_verified")
        j = j.join(ver, "customer_email", "left")
        verification = (F.when(F.col("all_verified"), F.lit("VERIFIED"))
                         .when(~F.col("all_verified"), F.lit("NOT_VERIFIED"))
                         .otherwise(F.lit("NOT_ERASED")))
    return j.select("customer_email", "active_before",
                    F.coalesce("records_discovered", F.lit(0)).cast("long").alias("records_discovered"),
                    "submit_outcome", "decision",
                    F.coalesce("notifications", F.lit(0)).cast("long").alias("notifications"),
                    verification.alias("verification"), "completed_after")

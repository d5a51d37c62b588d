"""Erasure-request workflow, re-aimed from one-e-mail procedures to batches.

Each function takes DataFrames of subjects / candidates / requests and
returns a DataFrame of outcomes; nothing loops on the driver.  ``as_of``
replaces the statement time and ids are hashes of natural keys, so a run is
reproducible (and re-running it is idempotent).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators.keyed import count_if, pick_one_per_key
from ..operators.skew import hot_keys, salted_join
from ..plans.reports import legal_hold_count
from ..sources.derived import VALID_REASONS

# Processors notified of an erasure.
PROCESSORS = ["GOOGLE_ANALYTICS", "MAILCHIMP", "SALESFORCE", "STRIPE", "ZENDESK"]
# Outcome messages.
MSG_BAD_REASON = ("ERROR: Invalid GDPR grounds for erasure. Must be one of: "
                  + ", ".join(VALID_REASONS))
MSG_ACTIVE = "ERROR: An active erasure request already exists for this email"
MSG_NO_EMAIL = "ERROR: customer_email is required"
MSG_SUBMITTED = "SUCCESS: Erasure request submitted with ID: "
MSG_NOT_FOUND = "ERROR: Erasure request not found"
MSG_NOT_PROCESSABLE = "ERROR: Request is not in a processable state. Current status: "
HOLD_BASIS = "Customer data under legal retention - cannot delete"  # stored with the request
MSG_HOLD = "ERROR: " + HOLD_BASIS  # returned to the caller
MSG_NO_ACTIVE = "ERROR: No active erasure request found for customer"


def _ts(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    if isinstance(as_of, dt.date) and not isinstance(as_of, dt.datetime):
        as_of = dt.datetime(as_of.year, as_of.month, as_of.day)
    return F.lit(as_of).cast("timestamp")


def _date(as_of) -> Column:
    return F.to_date(_ts(as_of))


def short_hash(*cols, n: int = 32) -> Column:
    """Deterministic id fragment: first ``n`` hex digits of SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, n)


def config_value(config: DataFrame, key: str, type_: str = "bigint") -> Column:
    """Typed value of a key of the key/JSON config table, as a scalar."""
    v = F.try_variant_get(F.try_parse_json("config_value"), "$", type_)
    return config.where(F.col("config_key") == key).select(v.alias("v")).scalar()


def submit_requests(candidates: DataFrame, customers: DataFrame, requests: DataFrame,
                    as_of, response_days: int | Column = 30) -> DataFrame:
    """Validate a batch of erasure submissions.

    ``candidates``: customer_email, erasure_reason, request_source (optional),
    submission_seq (order within the batch).  Outcome per candidate, checked
    in the reference's order: INVALID_REASON, ACTIVE_REQUEST_EXISTS (an open
    request in the table, or an earlier valid submission in this batch),
    ACCEPTED.  A NULL e-mail is MISSING_EMAIL (the column is NOT NULL).
    Accepted rows carry the new request's id and fields.
    """
    cand = candidates
    if "request_source" not in cand.columns:
        cand = cand.withColumn("request_source", F.lit("API"))
    valid = F.col("erasure_reason").isin(VALID_REASONS)
    open_emails = (requests.where(F.col("status").isin(C.OPEN_STATES))
                   .select(F.col("customer_email").alias("__open")).distinct())
    # an address may be hot or missing in a large batch: salted joins
    hot = hot_keys(cand, "customer_email")  # of the batch, for all its joins: those before the last add no row
    c = salted_join(cand, open_emails, "customer_email", "__open", "left", hot=hot)
    # first valid submission per e-mail in the batch: an aggregate, not a window
    first = (cand.where(valid & F.col("customer_email").isNotNull()).groupBy(F.col("customer_email").alias("__femail"))
             .agg(F.min("submission_seq").alias("__first")))
    c = salted_join(c, first, "customer_email", "__femail", "left", hot=hot)
    # a person may have submitted before, even on the same day: their earlier requests are counted in
    earlier = (requests.where(F.col("customer_email").isNotNull()).groupBy(F.col("customer_email").alias("__remail"))
               .agg(F.count(F.lit(1)).alias("__earlier")))
    c = salted_join(c, earlier, "customer_email", "__remail", "left", hot=hot)
    live = (customers.where(F.col("is_deleted") == F.lit(False))
            .select(F.col("email").alias("__cemail"), F.col("customer_id").alias("__cid")))
    c = salted_join(c, live, "customer_email", "__cemail", "left", hot=hot)
    a = _date(as_of)
    outcome = (F.when(F.col("customer_email").isNull(), "MISSING_EMAIL")
                .when(~valid | F.col("erasure_reason").isNull(), "INVALID_REASON")
                .when(F.col("__open").isNotNull(), "ACTIVE_REQUEST_EXISTS")
                .when(F.col("submission_seq") != F.col("__first"), "ACTIVE_REQUEST_EXISTS")
                .otherwise("ACCEPTED"))
    rid = F.concat(F.lit("REQ_"), F.year(a).cast("string"), F.lit("_"),
                   short_hash("customer_email", "erasure_reason", F.col("submission_seq").cast("string"), a.cast("string"),
                              F.coalesce("__earlier", F.lit(0)).cast("string")))
    accepted = F.col("outcome") == "ACCEPTED"
    return (c.withColumn("outcome", outcome)
             .select("customer_email", "erasure_reason", "request_source", "submission_seq",
                     "outcome",
                     F.when(accepted, rid).alias("request_id"),
                     F.when(accepted, F.col("__cid")).alias("customer_id"),
                     F.when(F.col("outcome") == "MISSING_EMAIL", F.lit(MSG_NO_EMAIL))
                      .when(F.col("outcome") == "INVALID_REASON", F.lit(MSG_BAD_REASON))
                      .when(F.col("outcome") == "ACTIVE_REQUEST_EXISTS", F.lit(MSG_ACTIVE))
                      .otherwise(F.concat(F.lit(MSG_SUBMITTED), rid)).alias("message"),
                     F.when(accepted, F.date_add(a, response_days)).alias("estimated_completion_date")))


def accepted_request_rows(submitted: DataFrame, as_of) -> DataFrame:
    """New ERASURE_REQUESTS rows for the accepted submissions."""
    from ..sources.schemas import conform
    acc = submitted.where(F.col("outcome") == "ACCEPTED")
    return conform(acc.select(
        "request_id", "customer_id", "customer_email", "erasure_reason", "request_source",
        "estimated_completion_date",
        F.lit("FULL_ERASURE").alias("request_type"), F.lit("SUBMITTED").alias("status"),
        _ts(as_of).alias("requested_at")), "erasure_requests", _ts(as_of))


def process_plan(to_process: DataFrame, requests: DataFrame, policies: DataFrame,
                 customers: DataFrame, as_of, honour_override: bool = True) -> DataFrame:
    """Decision for each request id: NOT_FOUND, NOT_PROCESSABLE, REJECTED
    (blocking legal hold), or IN_PROGRESS (erasure goes ahead)."""
    r = requests.select("request_id", "customer_email", "erasure_reason", "status")
    j = to_process.select("request_id").join(r, "request_id", "left")
    holds = legal_hold_count(policies, customers, as_of, honour_override).withColumnRenamed(
        "customer_email", "__hemail")
    # ids that do not exist have no address: the salted join spreads them
    j = salted_join(j, holds, "customer_email", "__hemail", "left")
    hc = F.coalesce(F.col("hold_count"), F.lit(0)).cast("long")
    decision = (F.when(F.col("customer_email").isNull(), "NOT_FOUND")
                 .when(~F.col("status").isin("SUBMITTED", "VALIDATED"), "NOT_PROCESSABLE")
                 .when(hc > 0, "REJECTED")
                 .otherwise("IN_PROGRESS"))
    return j.select(
        "request_id", "customer_email", "status", hc.alias("hold_count"),
        decision.alias("decision"),
        F.when(decision == "NOT_FOUND", F.lit(MSG_NOT_FOUND))
         .when(decision == "NOT_PROCESSABLE", F.concat(F.lit(MSG_NOT_PROCESSABLE), F.col("status")))
         .when(decision == "REJECTED", F.lit(MSG_HOLD))
         .otherwise(F.lit(None).cast("string")).alias("message"))


def apply_decisions(requests: DataFrame, plan: DataFrame, as_of) -> DataFrame:
    """Requests with the plan's status changes applied (REJECTED gets the
    hold text as legal override; IN_PROGRESS gets started_at)."""
    p = plan.where(F.col("decision").isin("REJECTED", "IN_PROGRESS")).select(
        F.col("request_id").alias("__rid"), "decision")
    j = requests.join(p, requests["request_id"] == p["__rid"], "left")
    d = F.col("decision")
    return j.select(*[
        (F.coalesce(d, F.col("status")).alias("status") if c == "status" else
         F.when(d == "REJECTED", F.lit(HOLD_BASIS)).otherwise(F.col(c)).alias(c)
         if c == "legal_basis_override" else
         F.when(d == "IN_PROGRESS", _ts(as_of)).otherwise(F.col(c)).alias(c)
         if c == "started_at" else F.col(c))
        for c in requests.columns])


def latest_active_requests(requests: DataFrame) -> DataFrame:
    act = requests.where(F.col("status").isin(C.ACTIVE_STATES))
    return pick_one_per_key(act, "customer_email", ["requested_at", "request_id"],
                            ["request_id", "requested_at"])


def coordinate_processors(subjects: DataFrame, requests: DataFrame, as_of,
                          processors: list[str] = PROCESSORS) -> DataFrame:
    """Processor notifications: each subject's newest IN_PROGRESS / COMPLETED
    request × the processor list (an ``explode`` of a literal array, not a
    cross join)."""
    from ..sources.schemas import conform
    s = subjects.select("customer_email").distinct()
    lat = latest_active_requests(requests)
    j = s.join(lat, "customer_email", "inner")
    x = j.select("request_id", "customer_email",
                 F.posexplode(F.array(*[F.lit(p) for p in processors])).alias("pos", "third_party_name"))
    rows = x.select(
        F.concat(F.lit("NOTIF_"), short_hash("request_id", "third_party_name", n=24)).alias("notification_id"),
        "request_id", "customer_email", "third_party_name",
        F.lit("PROCESSOR").alias("third_party_type"), F.lit("DELETION_REQUEST").alias("notification_type"),
        F.lit("API").alias("method"), F.lit("PENDING").alias("status"))
    return conform(rows, "third_party_notifications", _ts(as_of))


def coordination_outcome(subjects: DataFrame, requests: DataFrame,
                         processors: list[str] = PROCESSORS) -> DataFrame:
    """Per subject: the request used and the reference's result message."""
    s = subjects.select("customer_email").distinct()
    lat = latest_active_requests(requests)
    j = s.join(lat, "customer_email", "left")
    ok = ("SUCCESS: Third-party coordination initiated for: "
          + "".join(p + ", " for p in processors))
    return j.select("customer_email", "request_id",
                    F.when(F.col("request_id").isNull(), F.lit(MSG_NO_ACTIVE))
                     .otherwise(F.lit(ok)).alias("message"))


def subject_status(subjects: DataFrame, requests: DataFrame, customers: DataFrame) -> DataFrame:
    """Per subject: active request?, last request date, completed erasure?,
    retention date and consents of the live customer record."""
    agg = requests.groupBy("customer_email").agg(
        (count_if(F.col("status").isin(C.OPEN_STATES)) > 0).alias("has_active_request"),
        F.max("requested_at").alias("last_request_date"),
        (count_if(F.col("status") == "COMPLETED") > 0).alias("deletion_completed"))
    live = (customers.where(F.col("is_deleted") == F.lit(False))
            .select(F.col("email").alias("customer_email"), "data_retention_until",
                    F.col("consent_marketing").alias("marketing"),
                    F.col("consent_analytics").alias("analytics"), "consent_given_date"))
    s = subjects.select("customer_email").distinct()
    j = s.join(agg, "customer_email", "left").join(live, "customer_email", "left")
    return j.select(
        "customer_email",
        F.coalesce("has_active_request", F.lit(False)).alias("has_active_request"),
        "last_request_date",
        F.coalesce("deletion_completed", F.lit(False)).alias("deletion_completed"),
        "data_retention_until", "marketing", "analytics", "consent_given_date")


def subject_status_object(status: DataFrame) -> DataFrame:
    """The status as one JSON object per subject (the function's OBJECT)."""
    consent = F.when(F.col("marketing").isNotNull() | F.col("analytics").isNotNull()
                     | F.col("consent_given_date").isNotNull(),
                     F.struct("marketing", "analytics", "consent_given_date"))
    return status.select("customer_email", F.to_json(F.struct(
        "customer_email", "has_active_request", "last_request_date", "deletion_completed",
        "data_retention_until", consent.alias("consent_status"))).alias("compliance_status"))


def audit_append(events: DataFrame, user_name: str = "SYSTEM", role_name: str = "GDPR_ADMIN",
                 warehouse_name: str | None = None) -> DataFrame:
    """GDPR_AUDIT_LOG rows for a batch of events.

    ``events``: event_type, customer_email, event_description, event_data,
    event_timestamp.  ``audit_hash`` = SHA-256 of id || type || e-mail ||
    timestamp (NULL when any part is NULL, as the reference's ``||``)."""
    from ..sources.schemas import conform
    if warehouse_name is None:  # the compute that ran the job: the Spark application
        warehouse_name = events.sparkSession.sparkContext.appName
    ts_txt = F.col("event_timestamp").cast("string")
    aid = F.concat(F.lit("AUDIT_"), short_hash("event_type", "customer_email", ts_txt,
                                               "event_description", "event_data"))
    rows = events.select(
        aid.alias("audit_id"), "event_type", "event_timestamp", "customer_email",
        F.lit(user_name).alias("user_name"), F.lit(role_name).alias("role_name"),
        "event_description", "event_data", F.lit(warehouse_name).alias("warehouse_name"))
    rows = rows.withColumn("audit_hash", audit_hash_expr())
    return conform(rows, "gdpr_audit_log")


def audit_hash_expr() -> Column:
    return F.sha2(F.concat(F.col("audit_id"), F.col("event_type"), F.col("customer_email"),
                           F.col("event_timestamp").cast("string")), 256)


def audit_verify(audit: DataFrame) -> DataFrame:
    """Recompute each audit row's hash and compare with the stored one."""
    return audit.select("audit_id", "customer_email", "audit_hash",
                        (F.col("audit_hash") == audit_hash_expr()).alias("hash_matches"))


def complete_requests(requests: DataFrame, op_log: DataFrame, as_of,
                      processed: DataFrame | None = None) -> DataFrame:
    """Close requests whose erasure ran: COMPLETED when no table operation
    failed (else they stay IN_PROGRESS), with the per-table summary object
    and a verification hash.

    ``processed`` (request_id) are the requests the plan let through, by
    default those in the log; one whose subject had no rows has no operation
    and completes with an empty summary."""
    from .erasure import deletion_summary
    ops = (op_log.groupBy("request_id")
           .agg(count_if(F.col("operation_status") == "FAILED").alias("failed"))
           .join(deletion_summary(op_log), "request_id", "left"))
    ids = (processed if processed is not None else op_log).select("request_id").distinct()
    per = ids.join(ops, "request_id", "left").withColumn("deletion_summary", F.coalesce("deletion_summary", F.lit("{}")))
    r = requests.drop("deletion_summary").join(per, "request_id", "inner")
    done = F.coalesce(F.col("failed"), F.lit(0)) == 0
    a = _ts(as_of)
    return r.select(
        "request_id", "customer_email",
        F.when(done, F.lit("COMPLETED")).otherwise(F.lit("IN_PROGRESS")).alias("status"),
        F.when(done, a).alias("completed_at"),
        F.when(done, F.to_date(a)).alias("actual_completion_date"),
        "deletion_summary",
        F.when(done, F.sha2(F.concat(F.col("customer_email"), a.cast("string")), 256))
         .alias("verification_hash"))


def workflow_audit_events(submitted: DataFrame, completed: DataFrame,
                          notifications: DataFrame, as_of) -> DataFrame:
    """The audit events the workflow logs: submission (accepted rows),
    completion (with the deletion summary) and processor coordination (one
    per request notified).  Input of ``audit_append``."""
    ts = _ts(as_of)
    sub = submitted.where(F.col("outcome") == "ACCEPTED").select(
        F.lit("ERASURE_REQUEST_SUBMITTED").alias("event_type"), "customer_email",
        F.concat(F.lit("Erasure request submitted with reason: "), F.col("erasure_reason"))
         .alias("event_description"),
        F.to_json(F.struct("request_id", F.col("erasure_reason").alias("reason"))).alias("event_data"),
        ts.alias("event_timestamp"))
    done = completed.where(F.col("status") == "COMPLETED").select(
        F.lit("ERASURE_REQUEST_COMPLETED").alias("event_type"), "customer_email",
        F.lit("Erasure request completed successfully").alias("event_description"),
        F.concat(F.lit('{"request_id": "'), F.col("request_id"), F.lit('", "deletion_summary": '),
                 F.coalesce(F.col("deletion_summary"), F.lit("{}")), F.lit("}")).alias("event_data"),
        ts.alias("event_timestamp"))
    coord = (notifications.groupBy("request_id", "customer_email")
             .agg(F.array_sort(F.collect_list("third_party_name")).alias("systems"))
             .select(F.lit("THIRD_PARTY_COORDINATION_INITIATED").alias("event_type"), "customer_email",
                     F.lit("Third-party deletion coordination initiated").alias("event_description"),
                     F.to_json(F.struct("request_id", "systems")).alias("event_data"),
                     ts.alias("event_timestamp")))
    return sub.unionByName(done).unionByName(coord)

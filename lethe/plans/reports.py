"""Compliance reports: global and grouped aggregates, top-k, sorts.

Every report is a single aggregate over its input (partial aggregation on the
map side, one small exchange), so the cost is one scan of the input
regardless of how many measures are computed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators.keyed import count_if, pick_one_per_key
from ..operators.skew import salted_join


def _date(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = dt.date.fromisoformat(d)
    return F.lit(d)


def lookback_filter(df: DataFrame, ts_col: str, as_of, months: int) -> DataFrame:
    """Rows with ``ts_col >= as_of - months`` (DATEADD on a date)."""
    return df.where(F.col(ts_col) >= F.add_months(_date(as_of), -months).cast("timestamp"))


def between_dates(col: str, start, end) -> Column:
    return F.col(col).between(_date(start), _date(end))


def dashboard(requests: DataFrame, as_of, sla_days: int = 30, warn_days: int = 25) -> DataFrame:
    """The compliance dashboard: one row of request measures."""
    a = _date(as_of)
    r = lookback_filter(requests, "requested_at", as_of, 12)
    age = C.days_between("requested_at", a)
    open_ = F.col("status").isin(C.OPEN_STATES)
    done = F.col("status") == "COMPLETED"
    proc = F.when(done, C.days_between("requested_at", "completed_at"))
    overdue = count_if(open_ & (age > sla_days))
    week_ago = F.date_add(a, -7).cast("timestamp")
    agg = r.agg(
        count_if(F.col("status") == "SUBMITTED").alias("pending_requests"),
        count_if(F.col("status") == "VALIDATED").alias("validated_requests"),
        count_if(F.col("status") == "IN_PROGRESS").alias("in_progress_requests"),
        count_if(done).alias("completed_requests"),
        count_if(F.col("status") == "REJECTED").alias("rejected_requests"),
        overdue.alias("overdue_requests"),
        count_if(open_ & (age > warn_days) & (age <= sla_days)).alias("due_soon_requests"),
        F.round(F.avg(proc), 4).alias("avg_processing_days"),
        F.max(proc).alias("max_processing_days"),
        count_if(F.col("requested_at") >= week_ago).alias("requests_last_7_days"),
        count_if(F.col("completed_at") >= week_ago).alias("completions_last_7_days"),
    )
    return agg.withColumn("overall_compliance_status",
                          C.compliance_status("overdue_requests"))


def dashboard_brief(requests: DataFrame, discovered: DataFrame, as_of,
                    sla_days: int = 30) -> DataFrame:
    """The shorter dashboard: PENDING (= SUBMITTED), discovery totals and a
    two-state status.  ``discovered`` holds (customer_email, database_name,
    records_found) rows of a discovery run for the requests' subjects; every
    database it names counts as a system."""
    a = _date(as_of)
    r = lookback_filter(requests, "requested_at", as_of, 12)
    # per subject: records found and the databases that hold them (as many as
    # there are databases), so the systems need no second pass
    per_subject = (discovered.groupBy(F.col("customer_email").alias("__subject"))
                   .agg(F.sum("records_found").alias("records_discovered"),
                        F.array_sort(F.collect_set("database_name")).alias("__dbs")))
    j = salted_join(r, per_subject, "customer_email", "__subject", "left")
    pending = F.col("status").isin("SUBMITTED", "IN_PROGRESS")
    age = C.days_between("requested_at", a)
    overdue = count_if(pending & (age > sla_days))
    agg = j.agg(
        count_if(F.col("status") == "SUBMITTED").alias("pending_requests"),
        count_if(F.col("status") == "IN_PROGRESS").alias("in_progress_requests"),
        count_if(F.col("status") == "COMPLETED").alias("completed_requests"),
        overdue.alias("overdue_requests"),
        F.round(F.avg(F.when(F.col("status") == "COMPLETED",
                             C.days_between("requested_at", "completed_at"))), 4)
         .alias("avg_processing_days"),
        F.coalesce(F.sum("records_discovered"), F.lit(0)).cast("long").alias("total_records_discovered"),
        F.size(F.array_distinct(F.flatten(F.collect_set("__dbs")))).cast("long")
         .alias("systems_with_customer_data"),
    )
    return agg.withColumn("overall_compliance_status",
                          C.compliance_status("overdue_requests", two_state=True))


def retention_compliance(customers: DataFrame, orders: DataFrame, as_of) -> DataFrame:
    """Two labelled rows (customers, transactions) combined with UNION ALL."""
    a = _date(as_of)
    soon = F.add_months(a, 1)
    cust = (customers.where(F.col("is_deleted") == F.lit(False)).agg(
        F.count(F.lit(1)).alias("total_records"),
        count_if(F.col("data_retention_until") < a).alias("overdue_for_deletion"),
        count_if(F.col("data_retention_until").between(a, soon)).alias("due_soon"),
        count_if(F.col("consent_marketing") == F.lit(False)).alias("marketing_consent_withdrawn"),
        count_if(F.col("consent_analytics") == F.lit(False)).alias("analytics_consent_withdrawn"),
    ).select(F.lit("customers").alias("data_category"), "*"))
    deletable = F.col("can_be_deleted") == F.lit(True)
    tx = (orders.agg(
        F.count(F.lit(1)).alias("total_records"),
        count_if((F.col("legal_retention_until") < a) & deletable).alias("overdue_for_deletion"),
        count_if(F.col("legal_retention_until").between(a, soon) & deletable).alias("due_soon"),
    ).select(F.lit("transactions").alias("data_category"), "*",
             F.lit(0).cast("long").alias("marketing_consent_withdrawn"),
             F.lit(0).cast("long").alias("analytics_consent_withdrawn")))
    return cust.unionByName(tx)


def audit_summary(audit: DataFrame, as_of, months: int = 3) -> DataFrame:
    """Audit events per day and type over the last ``months`` months."""
    a = lookback_filter(audit, "event_timestamp", as_of, months)
    return (a.groupBy(F.to_date("event_timestamp").alias("audit_date"), "event_type")
             .agg(F.count(F.lit(1)).alias("event_count"),
                  F.count_distinct("customer_email").alias("unique_customers"),
                  F.count_distinct("user_name").alias("unique_users"),
                  F.min("event_timestamp").alias("first_event"),
                  F.max("event_timestamp").alias("last_event"))
             .orderBy(F.col("audit_date").desc(), F.col("event_count").desc()))


def active_request_count(requests: DataFrame) -> DataFrame:
    return (requests.groupBy("customer_email")
            .agg(count_if(F.col("status").isin(C.OPEN_STATES)).alias("active_requests")))


def last_request_date(requests: DataFrame) -> DataFrame:
    return requests.groupBy("customer_email").agg(F.max("requested_at").alias("last_request_date"))


def legal_holds(policies: DataFrame, customers: DataFrame, as_of,
                honour_override: bool = True) -> DataFrame:
    """Blocking holds (unexpired and, by default, not overridable) joined to
    their subject.  ``honour_override=False`` is the documented variant in
    which any unexpired hold blocks."""
    a = _date(as_of)
    blocking = policies.where(F.col("retention_end_date") > a)
    if honour_override:
        blocking = blocking.where(F.col("can_override_gdpr") == F.lit(False))
    per_customer = blocking.groupBy("customer_id").agg(F.count(F.lit(1)).alias("hold_count"))
    return (per_customer.join(customers.select("customer_id", "email"), "customer_id", "inner")
            .select(F.col("email").alias("customer_email"), "customer_id", "hold_count"))


def legal_hold_count(policies: DataFrame, customers: DataFrame, as_of,
                     honour_override: bool = True) -> DataFrame:
    return (legal_holds(policies, customers, as_of, honour_override)
            .groupBy("customer_email").agg(F.sum("hold_count").cast("long").alias("hold_count")))


def requests_topk(requests: DataFrame, as_of, limit: int = 10) -> DataFrame:
    """The ``limit`` newest requests (request_id breaks ties)."""
    return (requests.select(
                "request_id", "customer_email", "status", "erasure_reason", "requested_at",
                "estimated_completion_date",
                C.days_between("requested_at", _date(as_of)).alias("days_since_request"))
            .orderBy(F.col("requested_at").desc(), F.col("request_id").desc())
            .limit(limit))


def project_requests(requests: DataFrame, as_of) -> DataFrame:
    """Request columns plus age in days, unsorted and unlimited."""
    return requests.select(
        "request_id", "customer_email", "status", "erasure_reason", "requested_at",
        "estimated_completion_date",
        C.days_between("requested_at", _date(as_of)).alias("days_since_request"))


def latest_active_request(requests: DataFrame) -> DataFrame:
    """Per subject, the newest IN_PROGRESS / COMPLETED request (one row)."""
    act = requests.where(F.col("status").isin(C.ACTIVE_STATES))
    return pick_one_per_key(act, "customer_email", ["requested_at", "request_id"],
                            ["request_id", "requested_at", "status"])


def pending_notifications(notifications: DataFrame) -> DataFrame:
    return (notifications.where(F.col("status") == "PENDING")
            .select("customer_email", F.col("created_at").alias("deletion_request_date"),
                    F.col("third_party_name").alias("external_system_name"),
                    F.col("status").alias("notification_status")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables as one row (``<name>_rows`` columns)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n")
             for name, df in tables.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    names = list(tables)
    wide = u.groupBy().pivot("t", names).agg(F.first("n"))
    return wide.select(*[F.col(n).cast("long").alias(f"{n}_rows") for n in names])

"""Registered queries: reports, aggregates, top-k, filters and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators.skew import salted_join
from ..plans import reports as R
from ..sources.derived import AS_OF, EVENTS_AS_OF, VALID_REASONS
from ..session import materialize
from .core import canon_sql, register
from .oracle_base import with_tables

OPEN = "('SUBMITTED', 'VALIDATED', 'IN_PROGRESS')"
AGE = "date_diff('day', CAST(requested_at AS DATE), DATE '2001-08-01')"
PROC = "date_diff('day', CAST(requested_at AS DATE), CAST(completed_at AS DATE))"

DASHBOARD_SQL = f"""
SELECT count(*) FILTER (WHERE status = 'SUBMITTED') AS pending_requests,
       count(*) FILTER (WHERE status = 'VALIDATED') AS validated_requests,
       count(*) FILTER (WHERE status = 'IN_PROGRESS') AS in_progress_requests,
       count(*) FILTER (WHERE status = 'COMPLETED') AS completed_requests,
       count(*) FILTER (WHERE status = 'REJECTED') AS rejected_requests,
       count(*) FILTER (WHERE status IN {OPEN} AND {AGE} > 30) AS overdue_requests,
       count(*) FILTER (WHERE status IN {OPEN} AND {AGE} > 25 AND {AGE} <= 30) AS due_soon_requests,
       round(avg(CASE WHEN status = 'COMPLETED' THEN {PROC} END), 4) AS avg_processing_days,
       max(CASE WHEN status = 'COMPLETED' THEN {PROC} END) AS max_processing_days,
       count(*) FILTER (WHERE requested_at >= DATE '2001-08-01' - 7) AS requests_last_7_days,
       count(*) FILTER (WHERE completed_at >= DATE '2001-08-01' - 7) AS completions_last_7_days,
       CASE WHEN count(*) FILTER (WHERE status IN {OPEN} AND {AGE} > 30) = 0 THEN 'COMPLIANT'
            WHEN count(*) FILTER (WHERE status IN {OPEN} AND {AGE} > 30) <= 2 THEN 'AT_RISK'
            ELSE 'NON_COMPLIANT' END AS overall_compliance_status
FROM px_erasure_requests
WHERE requested_at >= DATE '2001-08-01' - INTERVAL 12 MONTH"""


@register("dashboard", with_tables("px_erasure_requests") + DASHBOARD_SQL)
def dashboard(m):
    """The compliance dashboard over the last year of requests."""
    return R.dashboard(m["erasure_requests"], AS_OF)


@register("compliance_status", with_tables("px_erasure_requests") + f"""
SELECT overall_compliance_status, overdue_requests FROM ({DASHBOARD_SQL})""")
def compliance_status(m):
    """Overall status from the number of overdue open requests."""
    return R.dashboard(m["erasure_requests"], AS_OF).select(
        "overall_compliance_status", "overdue_requests")


RETENTION_SQL = """
SELECT 'customers' AS data_category, count(*) AS total_records,
       count(*) FILTER (WHERE data_retention_until < DATE '2001-08-01') AS overdue_for_deletion,
       count(*) FILTER (WHERE data_retention_until BETWEEN DATE '2001-08-01'
                        AND DATE '2001-08-01' + INTERVAL 1 MONTH) AS due_soon,
       count(*) FILTER (WHERE consent_marketing = FALSE) AS marketing_consent_withdrawn,
       count(*) FILTER (WHERE consent_analytics = FALSE) AS analytics_consent_withdrawn
FROM px_customers WHERE is_deleted = FALSE
UNION ALL
SELECT 'transactions', count(*),
       count(*) FILTER (WHERE legal_retention_until < DATE '2001-08-01' AND can_be_deleted = TRUE),
       count(*) FILTER (WHERE legal_retention_until BETWEEN DATE '2001-08-01'
                        AND DATE '2001-08-01' + INTERVAL 1 MONTH AND can_be_deleted = TRUE),
       0, 0
FROM px_orders"""


@register("retention_compliance", with_tables("px_customers", "px_orders") + RETENTION_SQL)
def retention_compliance(m):
    """Retention and consent counts for customers and transactions."""
    return R.retention_compliance(m["customers"], m["orders"], AS_OF)


@register("union_all", with_tables("px_customers", "px_orders") + f"""
SELECT data_category, total_records FROM ({RETENTION_SQL})""")
def union_all(m):
    """The UNION ALL of the two labelled aggregate rows."""
    return R.retention_compliance(m["customers"], m["orders"], AS_OF).select(
        "data_category", "total_records")


AUDIT_SQL = """
SELECT CAST(event_timestamp AS DATE) AS audit_date, event_type,
       count(*) AS event_count,
       count(DISTINCT customer_email) AS unique_customers,
       count(DISTINCT user_name) AS unique_users,
       min(event_timestamp) AS first_event,
       max(event_timestamp) AS last_event
FROM px_audit_log
WHERE event_timestamp >= DATE '2024-01-31' - INTERVAL 3 MONTH
GROUP BY CAST(event_timestamp AS DATE), event_type
ORDER BY audit_date DESC, event_count DESC"""


@register("audit_summary", canon_sql(with_tables("px_audit_log") + AUDIT_SQL,
                                     ["audit_date", "first_event", "last_event"]))
def audit_summary(m):
    """Audit events per day and type, last three months."""
    return R.audit_summary(m["gdpr_audit_log"], EVENTS_AS_OF)


@register("sort_audit", canon_sql(with_tables("px_audit_log") + f"""
SELECT audit_date, event_type, event_count FROM ({AUDIT_SQL}) ORDER BY audit_date DESC, event_count DESC""",
                                  ["audit_date"]))
def sort_audit(m):
    """Audit summary ordered by day DESC, count DESC."""
    return (R.audit_summary(m["gdpr_audit_log"], EVENTS_AS_OF)
            .select("audit_date", "event_type", "event_count")
            .orderBy(F.col("audit_date").desc(), F.col("event_count").desc()))


HOLD_WHERE = "rp.retention_end_date > DATE '2001-08-01' AND rp.can_override_gdpr = FALSE"


@register("legal_hold_count", with_tables("px_retention_policies", "px_customers") + f"""
SELECT c.email AS customer_email, count(*) AS hold_count
FROM px_retention_policies rp JOIN px_customers c ON c.customer_id = rp.customer_id
WHERE {HOLD_WHERE} GROUP BY c.email""")
def legal_hold_count(m):
    """Blocking legal holds per subject."""
    return R.legal_hold_count(m["retention_policies"], m["customers"], AS_OF)


@register("legal_hold_join", with_tables("px_retention_policies", "px_customers") + f"""
SELECT c.email AS customer_email, c.customer_id, count(*) AS hold_count
FROM px_retention_policies rp JOIN px_customers c ON c.customer_id = rp.customer_id
WHERE {HOLD_WHERE} GROUP BY c.email, c.customer_id""")
def legal_hold_join(m):
    """Policies JOIN customers: unexpired, non-overridable holds per customer."""
    return R.legal_holds(m["retention_policies"], m["customers"], AS_OF)


@register("active_request_count", with_tables("px_erasure_requests") + f"""
SELECT customer_email, count(*) FILTER (WHERE status IN {OPEN}) AS active_requests
FROM px_erasure_requests GROUP BY customer_email""")
def active_request_count(m):
    """Open requests per subject."""
    return R.active_request_count(m["erasure_requests"])


@register("last_request_date", canon_sql(with_tables("px_erasure_requests") + """
SELECT customer_email, max(requested_at) AS last_request_date
FROM px_erasure_requests GROUP BY customer_email""", ["last_request_date"]))
def last_request_date(m):
    """Newest request time per subject."""
    return R.last_request_date(m["erasure_requests"])


REQ_COLS_SQL = f"""request_id, customer_email, status, erasure_reason, requested_at,
       estimated_completion_date, {AGE} AS days_since_request"""


@register("requests_topk", canon_sql(with_tables("px_erasure_requests") + f"""
SELECT {REQ_COLS_SQL} FROM px_erasure_requests
ORDER BY requested_at DESC, request_id DESC LIMIT 10""",
                                     ["requested_at", "estimated_completion_date"]))
def requests_topk(m):
    """The ten newest requests (a top-k report: the limit is the feature)."""
    return R.requests_topk(m["erasure_requests"], AS_OF, 10)


@register("project_requests", canon_sql(with_tables("px_erasure_requests") + f"""
SELECT {REQ_COLS_SQL} FROM px_erasure_requests""",
                                        ["requested_at", "estimated_completion_date"]))
def project_requests(m):
    """Request columns with age in days."""
    return R.project_requests(m["erasure_requests"], AS_OF)


@register("latest_active_request", canon_sql(with_tables("px_erasure_requests") + """
SELECT customer_email, request_id, requested_at, status FROM px_erasure_requests
WHERE status IN ('IN_PROGRESS', 'COMPLETED')
QUALIFY row_number() OVER (PARTITION BY customer_email
                           ORDER BY requested_at DESC, request_id DESC) = 1""", ["requested_at"]))
def latest_active_request(m):
    """Per subject, the newest IN_PROGRESS / COMPLETED request."""
    return R.latest_active_request(m["erasure_requests"])


@register("table_counts", with_tables("px_customers", "px_orders", "px_user_activities",
                                      "px_erasure_requests") + """
SELECT (SELECT count(*) FROM px_customers) AS customers_rows,
       (SELECT count(*) FROM px_orders) AS orders_rows,
       (SELECT count(*) FROM px_user_activities) AS user_activities_rows,
       (SELECT count(*) FROM px_erasure_requests) AS erasure_requests_rows""")
def table_counts(m):
    """Row counts of four tables in one row."""
    return R.table_counts({n: m[n] for n in ("customers", "orders", "user_activities",
                                             "erasure_requests")})


@register("sample_limit", with_tables("px_customers") + """
SELECT least(count(*), 5) AS sampled_rows, least(count(*), 5) AS customers_among_them FROM px_customers""")
def sample_limit(m):
    """Five customers, unsorted (a sampling preview: the limit is the feature):
    how many rows came, and how many of them are customers."""
    cols = ["customer_id", "email", "first_name", "last_name", "country_code", "consent_marketing", "consent_analytics"]
    c = m["customers"].select(*cols)
    five = materialize(c.limit(5).select(F.struct(*cols).alias("row")), "sample")  # an unsorted limit may differ when run again
    known = c.select(F.struct(*cols).alias("row")).join(F.broadcast(five), "row", "left_semi").distinct()  # five rows
    return five.join(known.withColumn("known", F.lit(1)), "row", "left").agg(
        F.count(F.lit(1)).alias("sampled_rows"), F.count("known").alias("customers_among_them"))


@register("filter_not_deleted", with_tables("px_customers") + """
SELECT customer_id, email FROM px_customers WHERE is_deleted = FALSE""")
def filter_not_deleted(m):
    """Customers not flagged as deleted."""
    return m["customers"].where(F.col("is_deleted") == F.lit(False)).select("customer_id", "email")


@register("subject_lookup", with_tables("px_erasure_requests", "px_customers") + """
SELECT r.request_id, r.customer_email, c.customer_id AS found_customer_id
FROM px_erasure_requests r
LEFT JOIN (SELECT customer_id, email FROM px_customers WHERE is_deleted = FALSE) c
  ON c.email = r.customer_email""")
def subject_lookup(m):
    """Each request's subject resolved to a live customer (NULL if none)."""
    live = (m["customers"].where(F.col("is_deleted") == F.lit(False))
            .select(F.col("customer_id").alias("found_customer_id"), F.col("email")))
    r = m["erasure_requests"].select("request_id", "customer_email")
    return salted_join(r, live, "customer_email", "email", "left").drop("email")


VALID_SQL = ", ".join(f"'{v}'" for v in VALID_REASONS)
DOC_SQL = ", ".join(f"'{v}'" for v in VALID_REASONS[:4])


@register("validate_reason", with_tables("px_erasure_requests") + f"""
SELECT request_id, erasure_reason,
       erasure_reason IN ({VALID_SQL}) AS reason_valid,
       erasure_reason IN ({DOC_SQL}) AS reason_valid_short_list
FROM px_erasure_requests""")
def validate_reason(m):
    """Reason checks against the six grounds and the documented four."""
    r = F.col("erasure_reason")
    return m["erasure_requests"].select(
        "request_id", "erasure_reason", r.isin(VALID_REASONS).alias("reason_valid"),
        r.isin(VALID_REASONS[:4]).alias("reason_valid_short_list"))


@register("lookback_filter", canon_sql(with_tables("px_erasure_requests") + """
SELECT request_id, requested_at FROM px_erasure_requests
WHERE requested_at >= DATE '2001-08-01' - INTERVAL 12 MONTH""", ["requested_at"]))
def lookback_filter(m):
    """Requests of the last 12 months."""
    return R.lookback_filter(m["erasure_requests"], "requested_at", AS_OF, 12).select(
        "request_id", "requested_at")


@register("between_dates", canon_sql(with_tables("px_customers") + """
SELECT customer_id, data_retention_until FROM px_customers
WHERE data_retention_until BETWEEN DATE '2001-08-01' AND DATE '2001-08-01' + INTERVAL 1 MONTH""",
                                     ["data_retention_until"]))
def between_dates(m):
    """Customers whose retention ends within the next month (inclusive)."""
    return m["customers"].where(R.between_dates("data_retention_until", AS_OF,
                                                F.add_months(F.lit(AS_OF), 1))).select(
        "customer_id", "data_retention_until")


@register("retention_bucket_counts", with_tables("px_customers") + """
SELECT CASE WHEN data_retention_until < DATE '2001-08-01' THEN 'OVERDUE_FOR_DELETION'
            WHEN data_retention_until <= DATE '2001-08-01' + INTERVAL 1 MONTH THEN 'DUE_FOR_DELETION_SOON'
            ELSE 'WITHIN_RETENTION_PERIOD' END AS retention_status,
       count(*) AS customers
FROM px_customers GROUP BY 1""")
def retention_bucket_counts(m):
    """Retention status of every customer (deleted included), counted."""
    return (m["customers"].groupBy(C.retention_status("data_retention_until", AS_OF)
                                   .alias("retention_status"))
            .agg(F.count(F.lit(1)).alias("customers")))


@register("legal_hold_any", with_tables("px_retention_policies", "px_customers") + """
SELECT c.email AS customer_email, count(*) AS hold_count
FROM px_retention_policies rp JOIN px_customers c ON c.customer_id = rp.customer_id
WHERE rp.retention_end_date > DATE '2001-08-01' GROUP BY c.email""")
def legal_hold_any(m):
    """Documented variant: every unexpired hold blocks (no override test)."""
    return R.legal_hold_count(m["retention_policies"], m["customers"], AS_OF, honour_override=False)

"""Registered queries: safe views, joins and row policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policies as P
from ..operators.skew import salted_join
from ..plans import views as V
from ..sources.derived import AS_OF
from .core import canon_sql, register
from .oracle_base import with_tables

CUSTOMER_COLS_SQL = """c.customer_id, c.email, c.first_name, c.last_name, c.phone_number,
       c.date_of_birth, c.address_line1, c.address_line2, c.city, c.state_province,
       c.postal_code, c.country_code, c.consent_marketing, c.consent_analytics,
       c.consent_given_date, c.lawful_basis, c.data_retention_until, c.created_at, c.updated_at"""

LATEST_SQL = """(SELECT er.customer_email, er.status, er.requested_at, er.completed_at
         FROM px_erasure_requests er
         JOIN (SELECT customer_email, max(requested_at) AS mx
               FROM px_erasure_requests GROUP BY customer_email) m
           ON er.customer_email = m.customer_email AND er.requested_at = m.mx)"""

# The three status rules and their labels.
COMPLIANT_SQL = f"""
SELECT {CUSTOMER_COLS_SQL},
       CASE WHEN er.status = 'COMPLETED' THEN 'DELETED'
            WHEN er.status IN ('SUBMITTED', 'VALIDATED', 'IN_PROGRESS') THEN 'DELETION_PENDING'
            ELSE 'ACTIVE' END AS gdpr_status,
       er.requested_at AS deletion_requested_at,
       er.completed_at AS deletion_completed_at,
       CASE WHEN c.data_retention_until < DATE '2001-08-01' THEN 'OVERDUE_FOR_DELETION'
            WHEN c.data_retention_until <= DATE '2001-09-01' THEN 'DUE_FOR_DELETION_SOON'
            ELSE 'WITHIN_RETENTION_PERIOD' END AS retention_status,
       CASE WHEN c.consent_given_date IS NULL THEN 'NO_CONSENT_RECORD'
            WHEN c.consent_marketing = FALSE AND c.consent_analytics = FALSE THEN 'ALL_CONSENT_WITHDRAWN'
            WHEN c.consent_marketing = FALSE THEN 'MARKETING_CONSENT_WITHDRAWN'
            WHEN c.consent_analytics = FALSE THEN 'ANALYTICS_CONSENT_WITHDRAWN'
            ELSE 'CONSENTED' END AS consent_status
FROM px_customers c
LEFT JOIN {LATEST_SQL} er ON c.email = er.customer_email
WHERE c.is_deleted = FALSE"""

COMPLIANT_TEMPORAL = ["date_of_birth", "consent_given_date", "data_retention_until",
                      "created_at", "updated_at", "deletion_requested_at",
                      "deletion_completed_at"]


def compliant(m):
    return V.customers_compliant(m["customers"], m["erasure_requests"], AS_OF)


@register("customers_compliant", canon_sql(
    with_tables("px_customers", "px_erasure_requests") + COMPLIANT_SQL, COMPLIANT_TEMPORAL))
def customers_compliant(m):
    """Compliant customer view: latest request (ties kept), three statuses."""
    return compliant(m)


# --- joins and statuses of the compliant view -------------------------------

@register("latest_request_join", canon_sql(
    with_tables("px_customers", "px_erasure_requests") + f"""
SELECT c.customer_id, c.email, er.status, er.requested_at
FROM px_customers c LEFT JOIN {LATEST_SQL} er ON c.email = er.customer_email""",
    ["requested_at"]))
def latest_request_join(m):
    """Every customer LEFT JOIN its newest request(s); ties duplicate."""
    j = V.latest_request_join(m["customers"].select("customer_id", "email"),
                              m["erasure_requests"])
    return j.select("customer_id", "email", "status", "requested_at")


@register("gdpr_status", with_tables("px_customers", "px_erasure_requests",
                                     compliant=COMPLIANT_SQL) + """
SELECT customer_id, gdpr_status, count(*) AS n FROM compliant GROUP BY customer_id, gdpr_status""")
def gdpr_status(m):
    """Erasure status of each live customer (one row per customer/status)."""
    return compliant(m).groupBy("customer_id", "gdpr_status").agg(F.count(F.lit(1)).alias("n"))


@register("retention_status", with_tables("px_customers", "px_erasure_requests",
                                          compliant=COMPLIANT_SQL) + """
SELECT DISTINCT customer_id, retention_status FROM compliant""")
def retention_status(m):
    """Retention status of each live customer."""
    return compliant(m).select("customer_id", "retention_status").distinct()


@register("consent_status", with_tables("px_customers", "px_erasure_requests",
                                        compliant=COMPLIANT_SQL) + """
SELECT consent_status, count(DISTINCT customer_id) AS customers FROM compliant GROUP BY consent_status""")
def consent_status(m):
    """Live customers per consent status."""
    return (compliant(m).groupBy("consent_status")
            .agg(F.count_distinct("customer_id").alias("customers")))


@register("project_safe_customer", with_tables("px_customers", "px_erasure_requests",
                                               compliant=COMPLIANT_SQL) + """
SELECT customer_id, email, gdpr_status, retention_status, consent_status,
       CAST(deletion_requested_at AS VARCHAR) AS deletion_requested_at
FROM compliant WHERE gdpr_status <> 'ACTIVE'""")
def project_safe_customer(m):
    """The derived columns of the view for customers with a request."""
    return (compliant(m).where(F.col("gdpr_status") != "ACTIVE")
            .select("customer_id", "email", "gdpr_status", "retention_status",
                    "consent_status", "deletion_requested_at"))


ORDERS_SAFE_SQL = """
SELECT o.order_id, o.customer_id,
       regexp_replace(o.customer_email, '^(.{2}).*(@.*)$', '\\1****\\2') AS customer_email,
       o.order_date, o.total_amount, 'USD' AS currency, o.payment_method,
       CASE WHEN json_extract_string(o.billing_address, '$.city') IS NULL
              OR json_extract_string(o.billing_address, '$.country') IS NULL THEN NULL
            ELSE '{"masked":"true","city":"' || json_extract_string(o.billing_address, '$.city')
                 || '","country":"' || json_extract_string(o.billing_address, '$.country') || '"}'
       END AS billing_address,
       o.order_status, o.legal_retention_until, o.can_be_deleted, o.created_at
FROM px_orders o JOIN compliant c ON o.customer_id = c.customer_id
WHERE c.gdpr_status <> 'DELETED'"""


@register("orders_safe", canon_sql(
    with_tables("px_customers", "px_erasure_requests", "px_orders", compliant=COMPLIANT_SQL)
    + ORDERS_SAFE_SQL, ["order_date", "legal_retention_until", "created_at"]))
def orders_safe(m):
    """Privacy-safe orders for an analyst: masked e-mail and address."""
    return V.orders_safe(m["orders"], compliant(m), "ANALYTICS_TEAM")


@register("orders_safe_join", with_tables("px_customers", "px_erasure_requests", "px_orders",
                                          compliant=COMPLIANT_SQL) + """
SELECT c.gdpr_status, count(*) AS orders
FROM px_orders o JOIN compliant c ON o.customer_id = c.customer_id GROUP BY c.gdpr_status""")
def orders_safe_join(m):
    """Orders INNER JOIN compliant customers (privileged: nothing filtered)."""
    c = compliant(m).select(F.col("customer_id").alias("cid"), "gdpr_status")
    orders = m["orders"].select("order_id", "customer_id")
    return (salted_join(orders, c, "customer_id", "cid", "inner")
            .groupBy("gdpr_status").agg(F.count(F.lit(1)).alias("orders")))


ACTIVITIES_SAFE_SQL = """
SELECT event_id,
       CASE WHEN is_pseudonymized THEN pseudonym_id ELSE customer_id END AS user_identifier,
       CASE WHEN is_pseudonymized THEN 'PSEUDONYMIZED_USER' ELSE user_email END AS user_email,
       session_id, event_type, event_timestamp, page_url,
       CASE WHEN is_pseudonymized THEN 'ANONYMIZED' ELSE user_agent END AS user_agent,
       CASE WHEN is_pseudonymized THEN 'XXX.XXX.XXX.XXX' ELSE ip_address END AS ip_address,
       device_type, browser, country_code, event_properties, is_pseudonymized,
       consent_for_analytics, created_at
FROM px_user_activities"""


@register("activities_safe", canon_sql(
    with_tables("px_user_activities") + ACTIVITIES_SAFE_SQL
    + "\nWHERE consent_for_analytics = TRUE OR is_pseudonymized = TRUE",
    ["event_timestamp", "created_at"]))
def activities_safe(m):
    """Analytics view for an analyst: consent or pseudonymized rows only."""
    return V.activities_safe(m["user_activities"], "ANALYTICS_TEAM")


@register("activity_anonymize", canon_sql(
    with_tables("px_user_activities") + ACTIVITIES_SAFE_SQL, ["event_timestamp", "created_at"]))
def activity_anonymize(m):
    """Identifier replacement of the analytics view, all rows (admin)."""
    return V.activities_safe(m["user_activities"], "GDPR_ADMIN")


# --- row access policies ----------------------------------------------------

NOT_IN_COMPLETED = "(SELECT customer_email FROM px_erasure_requests WHERE status = 'COMPLETED')"


@register("rap_erased", with_tables("px_user_activities", "px_erasure_requests") + f"""
SELECT event_id, user_email FROM px_user_activities WHERE user_email NOT IN {NOT_IN_COMPLETED}""")
def rap_erased(m):
    """Activities visible to customer service: erased subjects hidden."""
    return P.rap_erased(m["user_activities"], "user_email", m["erasure_requests"],
                        "CUSTOMER_SERVICE").select("event_id", "user_email")


@register("anti_erased", with_tables("px_orders", "px_erasure_requests") + f"""
SELECT order_id FROM px_orders WHERE customer_email NOT IN {NOT_IN_COMPLETED}""")
def anti_erased(m):
    """Orders NOT IN completed-erasure subjects (null-aware anti join)."""
    return P.not_in(m["orders"], "customer_email",
                    P.completed_subjects(m["erasure_requests"]), "customer_email").select("order_id")


@register("rap_marketing", with_tables("px_customers") + """
SELECT customer_id FROM px_customers WHERE consent_marketing = TRUE""")
def rap_marketing(m):
    """Customers visible to marketing: marketing consent given."""
    return P.rap_marketing(m["customers"], "MARKETING_TEAM").select("customer_id")


@register("rap_analytics", with_tables("px_customers") + """
SELECT customer_id FROM px_customers WHERE consent_analytics = TRUE""")
def rap_analytics(m):
    """Customers visible to analytics roles: analytics consent given."""
    return P.rap_analytics(m["customers"], "DATA_SCIENTIST").select("customer_id")


@register("rap_pseudonymized", with_tables("px_user_activities") + """
SELECT event_id FROM px_user_activities WHERE is_pseudonymized = FALSE""")
def rap_pseudonymized(m):
    """Activities visible to sales: pseudonymized rows hidden."""
    return P.rap_pseudonymized(m["user_activities"], "SALES").select("event_id")


@register("apply_row_policies", with_tables("px_user_activities", "px_customers",
                                            "px_erasure_requests") + f"""
SELECT 'user_activities' AS table_name, event_id AS row_id FROM px_user_activities
WHERE user_email NOT IN {NOT_IN_COMPLETED} AND is_pseudonymized = FALSE
UNION ALL
SELECT 'customers', customer_id FROM px_customers
WHERE email NOT IN {NOT_IN_COMPLETED} AND consent_marketing = TRUE""")
def apply_row_policies(m):
    """Attached policies folded per table: activities for SALES, customers
    for MARKETING_TEAM."""
    req = m["erasure_requests"]
    a = P.apply_row_policies(m["user_activities"], "user_activities", "SALES", req)
    c = P.apply_row_policies(m["customers"], "customers", "MARKETING_TEAM", req)
    return (a.select(F.lit("user_activities").alias("table_name"), F.col("event_id").alias("row_id"))
            .unionByName(c.select(F.lit("customers").alias("table_name"),
                                  F.col("customer_id").alias("row_id"))))


@register("secure_customers", canon_sql(with_tables("px_customers", "px_erasure_requests") + f"""
SELECT customer_id,
       regexp_replace(email, '^(.).*(@.*)$', '\\1****\\2') AS email,
       CASE WHEN length(first_name) > 1 THEN left(first_name, 1) || repeat('*', length(first_name) - 1)
            ELSE '*' END AS first_name,
       CASE WHEN length(phone_number) >= 10 THEN left(phone_number, 3) || '-***-' || right(phone_number, 4)
            ELSE '***-***-****' END AS phone_number,
       make_date(year(date_of_birth), 1, 1) AS date_of_birth,
       regexp_replace(address_line1, '\\d+', '***', 'g') AS address_line1,
       consent_marketing
FROM px_customers
WHERE email NOT IN {NOT_IN_COMPLETED} AND consent_marketing = TRUE""", ["date_of_birth"]))
def secure_customers(m):
    """Customers as marketing reads them: erased subjects and customers
    without marketing consent filtered on raw values, then masked."""
    t = V.secure_table(m["customers"], "customers", "MARKETING_TEAM", m["erasure_requests"])
    return t.select("customer_id", "email", "first_name", "phone_number", "date_of_birth",
                    "address_line1", "consent_marketing")

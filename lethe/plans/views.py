"""Privacy-safe views as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import masking as M
from ..operators.keyed import latest_per_key
from ..operators.skew import salted_join

# What the analytics view shows for pseudonymized rows.
PSEUDONYMIZED_EMAIL = "PSEUDONYMIZED_USER"
ANONYMIZED_AGENT = "ANONYMIZED"
ANONYMIZED_IP = "XXX.XXX.XXX.XXX"

# Customer columns exposed by the compliant view.
CUSTOMER_VIEW_COLUMNS = [
    "customer_id", "email", "first_name", "last_name", "phone_number", "date_of_birth",
    "address_line1", "address_line2", "city", "state_province", "postal_code",
    "country_code", "consent_marketing", "consent_analytics", "consent_given_date",
    "lawful_basis", "data_retention_until", "created_at", "updated_at",
]


def latest_requests(requests: DataFrame) -> DataFrame:
    """Each subject's newest request(s) by ``requested_at``; ties are kept."""
    return latest_per_key(
        requests.select("customer_email", "status", "requested_at", "completed_at"),
        "customer_email", "requested_at")


def latest_request_join(customers: DataFrame, requests: DataFrame) -> DataFrame:
    """Customers LEFT JOIN their newest request(s) on e-mail.

    Written as INNER JOIN UNION ALL (customers without a request): a subject
    whose newest requests are many tied rows would otherwise sit, whole, in
    one task as the non-splittable side of an outer join.  The inner join
    salts such hot subjects over several tasks, and the anti join probes
    distinct keys only."""
    lr = latest_requests(requests).withColumnRenamed("customer_email", "__req_email")
    # the request side may hold a hot subject (many tied rows): salted join
    matched = salted_join(lr, customers, "__req_email", "email", "inner").drop("__req_email")
    # e-mails that have a newest request = e-mails with a dated request: one
    # narrow scan with map-side de-duplication, not a second latest-pass
    keys = (requests.where(F.col("requested_at").isNotNull())
            .select(F.col("customer_email").alias("__req_email"))
            .where(F.col("__req_email").isNotNull()).distinct())
    unmatched = customers.join(keys, customers["email"] == keys["__req_email"], "left_anti")
    for f in lr.schema.fields:
        if f.name != "__req_email":
            unmatched = unmatched.withColumn(f.name, F.lit(None).cast(f.dataType))
    return matched.unionByName(unmatched)


def customers_compliant(customers: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """Non-deleted customers with erasure, retention and consent status."""
    live = customers.where(F.col("is_deleted") == F.lit(False))
    j = latest_request_join(live.select(*CUSTOMER_VIEW_COLUMNS), requests)
    return j.select(
        *CUSTOMER_VIEW_COLUMNS,
        C.gdpr_status("status").alias("gdpr_status"),
        F.col("requested_at").alias("deletion_requested_at"),
        F.col("completed_at").alias("deletion_completed_at"),
        C.retention_status("data_retention_until", as_of).alias("retention_status"),
        C.consent_status("consent_given_date", "consent_marketing",
                         "consent_analytics").alias("consent_status"),
    )


def orders_safe(orders: DataFrame, compliant: DataFrame, role: str) -> DataFrame:
    """Orders of visible customers with masked e-mail and billing address."""
    c = compliant.select(F.col("customer_id").alias("__cid"), "gdpr_status")
    # one customer may own a large share of all orders: salted join
    j = salted_join(orders, c, "customer_id", "__cid", "inner")
    if role not in ("ACCOUNTADMIN", "GDPR_ADMIN"):
        j = j.where(F.col("gdpr_status") != "DELETED")
    return j.select(
        "order_id", "customer_id",
        M.order_email("customer_email", role).alias("customer_email"),
        "order_date", "total_amount", "currency", "payment_method",
        M.json_mask_address("billing_address", role).alias("billing_address"),
        "order_status", "legal_retention_until", "can_be_deleted", "created_at",
    )


def activities_safe(activities: DataFrame, role: str) -> DataFrame:
    """Analytics view: pseudonymized rows lose identifiers; rows need analytics
    consent or pseudonymization unless the role is an administrator."""
    a = activities
    if role not in ("ACCOUNTADMIN", "GDPR_ADMIN"):
        a = a.where((F.col("consent_for_analytics") == F.lit(True))
                    | (F.col("is_pseudonymized") == F.lit(True)))
    p = F.col("is_pseudonymized") == F.lit(True)
    return a.select(
        "event_id",
        F.when(p, F.col("pseudonym_id")).otherwise(F.col("customer_id")).alias("user_identifier"),
        F.when(p, F.lit(PSEUDONYMIZED_EMAIL)).otherwise(F.col("user_email")).alias("user_email"),
        "session_id", "event_type", "event_timestamp", "page_url",
        F.when(p, F.lit(ANONYMIZED_AGENT)).otherwise(F.col("user_agent")).alias("user_agent"),
        F.when(p, F.lit(ANONYMIZED_IP)).otherwise(F.col("ip_address")).alias("ip_address"),
        "device_type", "browser", "country_code", "event_properties",
        "is_pseudonymized", "consent_for_analytics", "created_at",
    )


def secure_table(df: DataFrame, table: str, role: str, requests: DataFrame) -> DataFrame:
    """A table as ``role`` may read it: the row policies attached to the
    table are applied on the raw values first, then the column masks."""
    from ..operators.policies import apply_row_policies
    rows = apply_row_policies(df, table, role, requests)
    if table == "customers":
        return M.masked_customers(rows, role)
    if table in M.EMAIL_MASKED_COLUMNS:
        return M.masked_table(rows, table, role)
    return rows

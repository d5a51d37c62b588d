"""Row access policies as predicates over DataFrames.

The warehouse attaches policies to tables; here a policy is a function
``(DataFrame, role, ...) -> DataFrame`` and ``apply_row_policies`` folds the
policies attached to a table, ANDing them on raw values (masks are applied
after filtering).  A literal role lets Catalyst drop a policy entirely for
privileged roles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import not_in

# Roles each policy lets through unfiltered.
ERASED_VISIBLE = ["ACCOUNTADMIN", "GDPR_ADMIN", "DATA_PROTECTION_OFFICER"]
ADMINS = ["ACCOUNTADMIN", "GDPR_ADMIN"]
MARKETING_ROLES = ["MARKETING_TEAM"]
ANALYTICS_ROLES = ["ANALYTICS_TEAM", "DATA_SCIENTIST"]
PSEUDONYM_HIDDEN = ["CUSTOMER_SERVICE", "SALES"]


def completed_subjects(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("status") == "COMPLETED").select("customer_email")


def rap_erased(df: DataFrame, email_col: str, requests: DataFrame, role: str) -> DataFrame:
    """Hide rows of subjects whose erasure is COMPLETED (NOT IN semantics)."""
    if role in ERASED_VISIBLE:
        return df
    return not_in(df, email_col, completed_subjects(requests), "customer_email")


def rap_marketing(df: DataFrame, role: str, consent_col: str = "consent_marketing") -> DataFrame:
    if role in ADMINS or role not in MARKETING_ROLES:
        return df
    return df.where(F.col(consent_col) == F.lit(True))


def rap_analytics(df: DataFrame, role: str, consent_col: str = "consent_analytics") -> DataFrame:
    if role in ADMINS or role not in ANALYTICS_ROLES:
        return df
    return df.where(F.col(consent_col) == F.lit(True))


def rap_pseudonymized(df: DataFrame, role: str, flag_col: str = "is_pseudonymized") -> DataFrame:
    if role in ADMINS or role in ANALYTICS_ROLES:
        return df
    flag = F.col(flag_col)
    if role in PSEUDONYM_HIDDEN:
        return df.where(flag == F.lit(False))
    return df.where(flag.isNotNull())


# Table → attached policies: (policy, column arguments).
ATTACHMENTS = {
    "customers": [("erased", {"email_col": "email"}), ("marketing", {})],
    "orders": [("erased", {"email_col": "customer_email"})],
    "support_tickets": [("erased", {"email_col": "customer_email"})],
    "user_activities": [("erased", {"email_col": "user_email"}), ("pseudonymized", {})],
    "marketing_interactions": [("erased", {"email_col": "customer_email"})],
}


def apply_row_policies(df: DataFrame, table: str, role: str, requests: DataFrame,
                       extra: list[str] | None = None) -> DataFrame:
    """Apply every policy attached to ``table`` (plus ``extra`` policy names,
    e.g. ``"analytics"`` which is defined but attached to no table)."""
    out = df
    for name, args in ATTACHMENTS.get(table, []) + [(e, {}) for e in (extra or [])]:
        if name == "erased":
            out = rap_erased(out, args["email_col"], requests, role)
        elif name == "marketing":
            out = rap_marketing(out, role)
        elif name == "analytics":
            out = rap_analytics(out, role)
        elif name == "pseudonymized":
            out = rap_pseudonymized(out, role)
    return out

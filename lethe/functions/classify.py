"""Business CASE rules: personal-data classes, sensitivity and statuses.

All are ``Column`` expressions (no Python UDF), evaluated inside codegen.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _date(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = dt.date.fromisoformat(d)
    return F.lit(d)


# Column-name fragments that make a column a discovery candidate.
CANDIDATE_FRAGMENTS = ["EMAIL", "CUSTOMER", "USER", "PHONE", "ADDRESS", "NAME"]
# Fragments the classes below know but the candidate filter leaves out.
INTENDED_EXTRA_FRAGMENTS = ["SSN", "SOCIAL", "BIRTH"]

# Value patterns (whole-value match in classify_by_value).
EMAIL_RE = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
SSN_RE = r"\d{3}-\d{2}-\d{4}"
PHONE_RE = r"\+?\d{10,15}"
DATE_RE = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"

# Output labels of the rules below, in rule order.
PII_CLASSES = ["EMAIL_ADDRESS", "PHONE_NUMBER", "POSTAL_ADDRESS", "PERSONAL_NAME", "SSN",
               "DATE_OF_BIRTH", "POTENTIAL_PII", "IP_ADDRESS", "NON_PII"]
SENSITIVITY_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
GDPR_STATUSES = ["DELETED", "DELETION_PENDING", "ACTIVE"]
RETENTION_STATUSES = ["OVERDUE_FOR_DELETION", "DUE_FOR_DELETION_SOON", "WITHIN_RETENTION_PERIOD"]
CONSENT_STATUSES = ["NO_CONSENT_RECORD", "ALL_CONSENT_WITHDRAWN", "MARKETING_CONSENT_WITHDRAWN",
                    "ANALYTICS_CONSENT_WITHDRAWN", "CONSENTED"]
COMPLIANCE_STATUSES = ["COMPLIANT", "AT_RISK", "NON_COMPLIANT"]
OPERATION_TYPES = ["PSEUDONYMIZE", "DELETE"]

# Statuses.
OPEN_STATES = ["SUBMITTED", "VALIDATED", "IN_PROGRESS"]
ACTIVE_STATES = ["IN_PROGRESS", "COMPLETED"]
PSEUDONYMIZE_DB = "ANALYTICS_DB"
PSEUDONYMIZE_SCHEMAS = ["EVENTS", "ML_MODELS"]


def _has(name: Column, frag: str) -> Column:
    return F.upper(name).like(f"%{frag}%")


def is_candidate_column(name, intended: bool = False) -> Column:
    n = _col(name)
    frags = CANDIDATE_FRAGMENTS + (INTENDED_EXTRA_FRAGMENTS if intended else [])
    cond = _has(n, frags[0])
    for f in frags[1:]:
        cond = cond | _has(n, f)
    return cond


def classify_by_name(name) -> Column:
    n = _col(name)
    return (F.when(_has(n, "EMAIL"), "EMAIL_ADDRESS")
             .when(_has(n, "PHONE"), "PHONE_NUMBER")
             .when(_has(n, "ADDRESS"), "POSTAL_ADDRESS")
             .when(_has(n, "NAME") & ~_has(n, "USER"), "PERSONAL_NAME")
             .when(_has(n, "SSN") | _has(n, "SOCIAL"), "SSN")
             .when(_has(n, "BIRTH"), "DATE_OF_BIRTH")
             .otherwise("POTENTIAL_PII"))


def sensitivity(pii_class) -> Column:
    c = _col(pii_class)
    return (F.when(c.isin("SSN", "DATE_OF_BIRTH"), "CRITICAL")
             .when(c.isin("EMAIL_ADDRESS", "PHONE_NUMBER", "POSTAL_ADDRESS"), "HIGH")
             .when(c == "PERSONAL_NAME", "MEDIUM")
             .otherwise("LOW"))


def severity_rank(level) -> Column:
    """Numeric order of sensitivity levels (CRITICAL highest)."""
    c = _col(level)
    return (F.when(c == "CRITICAL", 4).when(c == "HIGH", 3)
             .when(c == "MEDIUM", 2).when(c == "LOW", 1).otherwise(0))


def full_match(val: Column, pattern: str) -> Column:
    """Whole-value regular-expression match (the warehouse's REGEXP_LIKE)."""
    return val.rlike(f"^(?:{pattern})$")


def classify_by_value(name, sample) -> Column:
    n, v = _col(name), _col(sample)
    return (F.when(full_match(v, EMAIL_RE), "EMAIL_ADDRESS")
             .when(full_match(v, SSN_RE), "SSN")
             .when(full_match(v, PHONE_RE), "PHONE_NUMBER")
             .when(full_match(v, DATE_RE), "DATE_OF_BIRTH")
             .when(_has(n, "NAME"), "PERSONAL_NAME")
             .when(_has(n, "ADDRESS"), "POSTAL_ADDRESS")
             .when(_has(n, "IP"), "IP_ADDRESS")
             .otherwise("NON_PII"))


def operation_type(database, schema) -> Column:
    return F.when((_col(database) == PSEUDONYMIZE_DB) & _col(schema).isin(PSEUDONYMIZE_SCHEMAS),
                  "PSEUDONYMIZE").otherwise("DELETE")


def gdpr_status(request_status) -> Column:
    s = _col(request_status)
    return (F.when(s == "COMPLETED", "DELETED")
             .when(s.isin(OPEN_STATES), "DELETION_PENDING")
             .otherwise("ACTIVE"))


def retention_status(retention_until, as_of) -> Column:
    r, a = _col(retention_until), _date(as_of)
    return (F.when(r < a, "OVERDUE_FOR_DELETION")
             .when(r <= F.add_months(a, 1), "DUE_FOR_DELETION_SOON")
             .otherwise("WITHIN_RETENTION_PERIOD"))


def consent_status(given_date, marketing, analytics) -> Column:
    g, m, a = _col(given_date), _col(marketing), _col(analytics)
    return (F.when(g.isNull(), "NO_CONSENT_RECORD")
             .when((m == F.lit(False)) & (a == F.lit(False)), "ALL_CONSENT_WITHDRAWN")
             .when(m == F.lit(False), "MARKETING_CONSENT_WITHDRAWN")
             .when(a == F.lit(False), "ANALYTICS_CONSENT_WITHDRAWN")
             .otherwise("CONSENTED"))


def compliance_status(overdue_count, two_state: bool = False) -> Column:
    o = _col(overdue_count)
    if two_state:
        return F.when(o == 0, "COMPLIANT").otherwise("NON_COMPLIANT")
    return (F.when(o == 0, "COMPLIANT").when(o <= 2, "AT_RISK").otherwise("NON_COMPLIANT"))


def days_between(start, end) -> Column:
    """DATEDIFF('day', start, end): midnights crossed from start to end."""
    return F.datediff(F.to_date(_col(end)), F.to_date(_col(start)))

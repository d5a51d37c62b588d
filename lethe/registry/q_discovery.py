"""Registered queries: discovery, content scanning, redaction, access audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators.keyed import broadcast_if_small, place_in_order
from ..plans import discovery as D
from ..sources.derived import DERIVED
from ..sources.tables import DRIVER_SCHEMAS
from .core import register
from .oracle_base import with_tables

# Oracle side: e-mail columns of the in-scope derived tables, in long form.
LONG_SQL = """
SELECT 'CUSTOMER_DATA_DB' AS database_name, 'CORE' AS schema_name, 'CUSTOMERS' AS table_name,
       'EMAIL' AS column_name, email AS value FROM px_customers
UNION ALL SELECT 'CUSTOMER_DATA_DB', 'TRANSACTIONS', 'ORDERS', 'CUSTOMER_EMAIL', customer_email FROM px_orders
UNION ALL SELECT 'CUSTOMER_DATA_DB', 'SUPPORT', 'SUPPORT_TICKETS', 'CUSTOMER_EMAIL', customer_email FROM px_support_tickets
UNION ALL SELECT 'ANALYTICS_DB', 'EVENTS', 'USER_ACTIVITIES', 'USER_EMAIL', user_email FROM px_user_activities
UNION ALL SELECT 'ANALYTICS_DB', 'CAMPAIGNS', 'MARKETING_INTERACTIONS', 'CUSTOMER_EMAIL', customer_email
          FROM px_marketing_interactions
UNION ALL SELECT 'COMPLIANCE_DB', 'REQUESTS', 'ERASURE_REQUESTS', 'CUSTOMER_EMAIL', customer_email
          FROM px_erasure_requests
UNION ALL SELECT 'COMPLIANCE_DB', 'AUDIT', 'GDPR_AUDIT_LOG', 'CUSTOMER_EMAIL', customer_email FROM px_audit_log"""

# Name fragments, written out again on the oracle side.
SQL_FRAGMENTS = ["EMAIL", "CUSTOMER", "USER", "PHONE", "ADDRESS", "NAME", "SSN", "SOCIAL", "BIRTH"]
CLASS_SQL = """CASE WHEN upper({c}) LIKE '%EMAIL%' THEN 'EMAIL_ADDRESS'
            WHEN upper({c}) LIKE '%PHONE%' THEN 'PHONE_NUMBER'
            WHEN upper({c}) LIKE '%ADDRESS%' THEN 'POSTAL_ADDRESS'
            WHEN upper({c}) LIKE '%NAME%' AND upper({c}) NOT LIKE '%USER%' THEN 'PERSONAL_NAME'
            WHEN upper({c}) LIKE '%SSN%' OR upper({c}) LIKE '%SOCIAL%' THEN 'SSN'
            WHEN upper({c}) LIKE '%BIRTH%' THEN 'DATE_OF_BIRTH'
            ELSE 'POTENTIAL_PII' END"""
SENS_SQL = """CASE WHEN {p} IN ('SSN', 'DATE_OF_BIRTH') THEN 'CRITICAL'
            WHEN {p} IN ('EMAIL_ADDRESS', 'PHONE_NUMBER', 'POSTAL_ADDRESS') THEN 'HIGH'
            WHEN {p} = 'PERSONAL_NAME' THEN 'MEDIUM' ELSE 'LOW' END"""

DISCOVERED_SQL = f"""
SELECT s.customer_email, l.database_name, l.schema_name, l.table_name, l.column_name,
       {CLASS_SQL.format(c='l.column_name')} AS pii_classification,
       count(*) AS records_found,
       {SENS_SQL.format(p=CLASS_SQL.format(c='l.column_name'))} AS sensitivity_level
FROM long l JOIN (SELECT DISTINCT customer_email FROM px_erasure_requests) s
  ON l.value = s.customer_email
GROUP BY ALL"""

DISC_TABLES = ("px_customers", "px_orders", "px_support_tickets", "px_user_activities",
               "px_marketing_interactions", "px_erasure_requests", "px_audit_log")


def _disc_with(**extra):
    return with_tables(*DISC_TABLES, long=LONG_SQL, discovered=DISCOVERED_SQL, **extra)


def subjects(m):
    """Every subject with an erasure request (the whole request table)."""
    return m["erasure_requests"].select("customer_email")


def observed(m):
    return D.discover_subjects(m, subjects(m), mode="observed")


@register("discover_subjects", _disc_with() + "SELECT * FROM discovered")
def discover_subjects(m):
    """Where each requesting subject's data lives (e-mail columns)."""
    return observed(m)


@register("discover_subjects_large", _disc_with() + "SELECT * FROM discovered")
def discover_subjects_large(m):
    """Discovery as for a subject set too large to broadcast: a Bloom filter of the
    keys before the shuffle, then the join on what passes."""
    return D.discover_subjects(m, subjects(m), mode="observed", max_broadcast_rows=0)


_CATALOG_VALUES = ",\n".join(
    f"('{r[0]}', '{r[1]}', '{r[2]}', '{r[3]}')"
    for r in D.declared_catalog_rows(list(DERIVED)))
CANDIDATES_SQL = f"""
SELECT database_name, schema_name, table_name, column_name,
       {CLASS_SQL.format(c='column_name')} AS pii_classification,
       {SENS_SQL.format(p=CLASS_SQL.format(c='column_name'))} AS sensitivity_level
FROM (VALUES {_CATALOG_VALUES}) AS t(database_name, schema_name, table_name, column_name)
WHERE """ + " OR ".join(f"upper(column_name) LIKE '%{f}%'" for f in SQL_FRAGMENTS)

INTENDED_SQL = """
SELECT p.customer_email, c.database_name, c.schema_name, c.table_name, c.column_name,
       c.pii_classification, p.records_found, c.sensitivity_level
FROM (SELECT customer_email, database_name, schema_name, table_name,
             CAST(sum(records_found) AS BIGINT) AS records_found
      FROM discovered GROUP BY ALL) p
JOIN candidates c USING (database_name, schema_name, table_name)"""


@register("discover_subjects_intended", _disc_with(candidates=CANDIDATES_SQL) + INTENDED_SQL)
def discover_subjects_intended(m):
    """Intended discovery: every candidate column of a matching table."""
    return D.discover_subjects(m, subjects(m), mode="intended")


@register("discovery_join", _disc_with() + """
SELECT customer_email, table_name, CAST(sum(records_found) AS BIGINT) AS matched_rows
FROM discovered GROUP BY customer_email, table_name""")
def discovery_join(m):
    """Long-form e-mail values joined to the subject set, per table."""
    return (observed(m).groupBy("customer_email", "table_name")
            .agg(F.sum("records_found").cast("long").alias("matched_rows")))


@register("discovery_summary", _disc_with() + """
SELECT customer_email, CAST(sum(records_found) AS BIGINT) AS total_records,
       count(DISTINCT database_name) AS systems_affected,
       count(*) FILTER (WHERE sensitivity_level = 'HIGH') AS high_sensitivity_items
FROM discovered GROUP BY customer_email""")
def discovery_summary(m):
    """Per subject: records found, systems affected, HIGH items."""
    return D.discovery_summary(observed(m))


@register("distinct_tables", _disc_with() + """
SELECT DISTINCT customer_email, database_name, schema_name, table_name
FROM discovered WHERE records_found > 0""")
def distinct_tables(m):
    """Distinct (database, schema, table) holding each subject's data."""
    return D.distinct_tables(observed(m))


@register("sort_discovery", _disc_with() + """
SELECT *, CAST(CASE sensitivity_level WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3
                                      WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS BIGINT) AS severity
FROM discovered ORDER BY sensitivity_level DESC, records_found DESC""")
def sort_discovery(m):
    """Discovery in the reference's order, with a numeric severity column."""
    return D.sort_discovery(observed(m)).withColumn(
        "severity", C.severity_rank("sensitivity_level"))


@register("discovery_results", _disc_with() + """
SELECT 'DISC_' || substr(sha256(r.request_id || '|' || d.database_name || '|' || d.schema_name
                                || '|' || d.table_name || '|' || d.column_name), 1, 16)
       || '_' || replace(d.customer_email, '@', '_AT_') AS discovery_id,
       r.request_id, d.customer_email, d.database_name, d.schema_name, d.table_name,
       d.column_name, d.pii_classification, d.records_found,
       d.sensitivity_level IN ('HIGH', 'CRITICAL') AS sensitive_data_detected,
       TRUE AS can_be_deleted
FROM discovered d JOIN px_erasure_requests r ON r.customer_email = d.customer_email""")
def discovery_results(m):
    """Discovery rows stored per request, carrying the erasure request id."""
    return D.discovery_results(observed(m), m["erasure_requests"])


@register("dashboard_brief", _disc_with() + """
SELECT count(*) FILTER (WHERE status = 'SUBMITTED') AS pending_requests,
       count(*) FILTER (WHERE status = 'IN_PROGRESS') AS in_progress_requests,
       count(*) FILTER (WHERE status = 'COMPLETED') AS completed_requests,
       count(*) FILTER (WHERE status IN ('SUBMITTED', 'IN_PROGRESS') AND
             date_diff('day', CAST(requested_at AS DATE), DATE '2001-08-01') > 30) AS overdue_requests,
       round(avg(CASE WHEN status = 'COMPLETED' THEN
             date_diff('day', CAST(requested_at AS DATE), CAST(completed_at AS DATE)) END), 4)
             AS avg_processing_days,
       CAST(coalesce(sum(records_discovered), 0) AS BIGINT) AS total_records_discovered,
       (SELECT count(DISTINCT database_name) FROM discovered
        WHERE customer_email IN (SELECT customer_email FROM px_erasure_requests
                                 WHERE requested_at >= DATE '2001-08-01' - INTERVAL 12 MONTH))
             AS systems_with_customer_data,
       CASE WHEN count(*) FILTER (WHERE status IN ('SUBMITTED', 'IN_PROGRESS') AND
             date_diff('day', CAST(requested_at AS DATE), DATE '2001-08-01') > 30) = 0
            THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS overall_compliance_status
FROM px_erasure_requests r
LEFT JOIN (SELECT customer_email, sum(records_found) AS records_discovered
           FROM discovered GROUP BY customer_email) d USING (customer_email)
WHERE r.requested_at >= DATE '2001-08-01' - INTERVAL 12 MONTH""")
def dashboard_brief(m):
    """The documented short dashboard, with discovery totals."""
    from ..plans.reports import dashboard_brief as brief
    from ..sources.derived import AS_OF
    return brief(m["erasure_requests"], observed(m), AS_OF)


# --- content scanning -------------------------------------------------------

#: Every string column of every input table.
SCAN_TEXT = {t: [f.split()[0] for f in ddl.split(",") if f.split()[1].lower() == "string"]
             for t, ddl in DRIVER_SCHEMAS.items()}
SCAN_TEXT = {t: cols for t, cols in SCAN_TEXT.items() if cols}
# Fixed values, written out again on the oracle side.
EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SSN_SQL, PHONE_SQL, DATE_SQL = r"\d{3}-\d{2}-\d{4}", r"\+?\d{10,15}", r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"


def _scan_sql() -> str:
    parts = []
    for t, cols in SCAN_TEXT.items():
        for c in cols:
            parts.append(f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS rows_scanned,
       count({c}) AS non_null,
       count(*) FILTER (WHERE regexp_matches({c}, '{EMAIL_SQL}')) AS email_hits,
       count(*) FILTER (WHERE regexp_matches({c}, '{SSN_SQL}')) AS ssn_hits,
       count(*) FILTER (WHERE regexp_matches({c}, '{PHONE_SQL}')) AS phone_hits,
       count(*) FILTER (WHERE regexp_matches({c}, '{DATE_SQL}')) AS date_hits
FROM {t}""")
    inner = "\nUNION ALL\n".join(parts)
    return f"""SELECT *, round(email_hits / greatest(rows_scanned, 1), 6) AS email_share
FROM ({inner})"""


@register("pii_scan", _scan_sql())
def pii_scan(m):
    """Personal-data pattern hits in every string column of every input table."""
    t = m.tables
    return D.pii_scan({n: t[n] for n in SCAN_TEXT}, SCAN_TEXT)


#: Every column of JSON text of the input tables and of the tables reached along a key.
SCAN_JSON = {"events": ["props"], "user_preferences": ["preference_value"], "customer_ml_features": ["features"]}


@register("pii_scan_leaves", f"""
WITH texts AS (
  SELECT 'events' AS table_name, 'props' AS column_name, props AS t FROM events
  UNION ALL SELECT 'user_preferences', 'preference_value', '{{"segment": "' || c_mktsegment || '"}}' FROM customer
  UNION ALL SELECT 'customer_ml_features', 'features', '{{"balance": ' || CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR)
                   || ', "segment": "' || c_mktsegment || '"}}' FROM customer),
leaves AS (
  SELECT table_name, column_name, regexp_replace(j.fullkey, '\\[[0-9]+\\]', '[*]', 'g') AS path,
         json_extract_string(j.atom, '$') AS leaf
  FROM texts, json_tree(texts.t) AS j WHERE j.type NOT IN ('OBJECT', 'ARRAY'))
SELECT table_name, column_name, path, count(*) AS leaves, count(leaf) AS non_null,
       count(*) FILTER (WHERE regexp_matches(leaf, '{EMAIL_SQL}')) AS email_hits,
       count(*) FILTER (WHERE regexp_matches(leaf, '{SSN_SQL}')) AS ssn_hits,
       count(*) FILTER (WHERE regexp_matches(leaf, '{PHONE_SQL}')) AS phone_hits,
       count(*) FILTER (WHERE regexp_matches(leaf, '{DATE_SQL}')) AS date_hits,
       round(count(*) FILTER (WHERE regexp_matches(leaf, '{EMAIL_SQL}')) / greatest(count(*), 1), 6) AS email_share
FROM leaves GROUP BY ALL""")
def pii_scan_leaves(m):
    """Personal-data pattern hits inside every JSON column, by path."""
    tables = {n: m.tables[n] if n in DRIVER_SCHEMAS else m[n] for n in SCAN_JSON}
    return D.pii_scan_leaves(tables, SCAN_JSON)


@register("pii_text_redact", f"""
WITH s1 AS (SELECT doc_id, text AS t0,
                   len(regexp_extract_all(text, '{EMAIL_SQL}')) AS email_found,
                   regexp_replace(text, '{EMAIL_SQL}', '[EMAIL]', 'g') AS t1 FROM documents),
     s2 AS (SELECT *, len(regexp_extract_all(t1, '{SSN_SQL}')) AS ssn_found,
                   regexp_replace(t1, '{SSN_SQL}', '[SSN]', 'g') AS t2 FROM s1),
     s3 AS (SELECT *, len(regexp_extract_all(t2, '{PHONE_SQL}')) AS phone_found,
                   regexp_replace(t2, '{PHONE_SQL}', '[PHONE]', 'g') AS t3 FROM s2)
SELECT doc_id, email_found, ssn_found, phone_found, t3 AS redacted_text FROM s3""")
def pii_text_redact(m):
    """Free-text redaction of e-mails, SSNs and phone numbers (whole texts)."""
    return D.pii_text_redact(m.tables["documents"], "doc_id", "text")


ACCESSED_SQL = f"""
SELECT query_id, user_name, role_name, CAST(start_time AS VARCHAR) AS start_time,
       nullif(regexp_extract(query_text, '{EMAIL_SQL}', 0), '') AS customer_email_accessed
FROM px_query_log
WHERE query_text ILIKE '%customer%' OR query_text ILIKE '%email%' OR query_text ILIKE '%personal%'"""


@register("access_audit", with_tables("px_query_log") + ACCESSED_SQL)
def access_audit(m):
    """Statements that touch customer data: who, as what, when, and the e-mail they mention."""
    return D.access_audit(m["query_log"], "query_text", "start_time", ["query_id", "user_name", "role_name", "start_time"])


@register("sort_access", with_tables("px_query_log") + f"SELECT query_id, customer_email_accessed, "
          f"row_number() OVER (ORDER BY start_time DESC, query_id DESC) AS place FROM ({ACCESSED_SQL})")
def sort_access(m):
    """Every statement that touches customer data, newest first, with its place."""
    log = D.access_audit(m["query_log"], "query_text", "start_time", ["query_id", "start_time"])
    placed = place_in_order(log, [F.col("start_time").desc(), F.col("query_id").desc()], "place")
    return placed.select("query_id", "customer_email_accessed", "place").orderBy("place")


@register("name_pattern", _disc_with(candidates=CANDIDATES_SQL) + """
SELECT c.table_name, c.column_name, c.pii_classification, count(DISTINCT p.customer_email) AS subjects
FROM candidates c JOIN discovered p USING (database_name, schema_name, table_name)
WHERE upper(c.column_name) LIKE '%NAME%'
GROUP BY ALL""")
def name_pattern(m):
    """Candidate columns matching %NAME% in tables holding subject data,
    with the number of subjects found there."""
    cat = D.column_catalog(m.spark, m)
    cands = D.candidate_columns(cat, intended=True).where(F.upper("column_name").like("%NAME%"))
    per_table = observed(m).select("customer_email", "database_name", "schema_name", "table_name")
    j = per_table.join(broadcast_if_small(cands), ["database_name", "schema_name", "table_name"])
    return (j.groupBy("table_name", "column_name", "pii_classification")
            .agg(F.count_distinct("customer_email").alias("subjects")))


@register("classify_by_name", _disc_with(candidates=CANDIDATES_SQL) + """
SELECT DISTINCT c.table_name, c.column_name, c.pii_classification
FROM candidates c JOIN discovered p USING (database_name, schema_name, table_name)""")
def classify_by_name(m):
    """Name-based class of every candidate column of tables holding
    requesting subjects' data."""
    d = D.discover_subjects(m, subjects(m), mode="intended")
    return d.select("table_name", "column_name", "pii_classification").distinct()


@register("sensitivity", _disc_with(candidates=CANDIDATES_SQL) + """
SELECT c.sensitivity_level, count(DISTINCT c.table_name || '.' || c.column_name) AS columns,
       CAST(sum(p.records_found) AS BIGINT) AS records
FROM candidates c
JOIN (SELECT database_name, schema_name, table_name, sum(records_found) AS records_found
      FROM discovered GROUP BY ALL) p USING (database_name, schema_name, table_name)
GROUP BY c.sensitivity_level""")
def sensitivity(m):
    """Candidate columns and matched records per sensitivity level."""
    d = D.discover_subjects(m, subjects(m), mode="intended")
    return (d.groupBy("sensitivity_level")
            .agg(F.count_distinct(F.concat_ws(".", "table_name", "column_name")).alias("columns"),
                 F.sum("records_found").cast("long").alias("records")))

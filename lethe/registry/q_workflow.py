"""Registered queries: request workflow, erasure, verification, key checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..plans import discovery as D
from ..plans import erasure as X
from ..plans import export as E
from ..plans import requests as Q
from ..session import materialize, release, scratch_mark, scratch_path
from ..sources.derived import AS_OF, VALID_REASONS
from ..sources.tables import DRIVER_SCHEMAS
from .core import canon_sql, register
from .oracle_base import with_tables

SALT = "lethe-fixed-salt"  # a fixed salt makes pseudonyms comparable in checks
OPEN = "('SUBMITTED', 'VALIDATED', 'IN_PROGRESS')"
# Fixed values, written out again on the oracle side so that a wrong constant in the engine shows.
VALID_SQL = ("'WITHDRAWN_CONSENT', 'NO_LONGER_NECESSARY', 'UNLAWFUL_PROCESSING', 'OBJECTION', "
             "'LEGAL_COMPLIANCE', 'CHILD_CONSENT'")
SQL_BAD_REASON = ("ERROR: Invalid GDPR grounds for erasure. Must be one of: WITHDRAWN_CONSENT, NO_LONGER_NECESSARY, "
                  "UNLAWFUL_PROCESSING, OBJECTION, LEGAL_COMPLIANCE, CHILD_CONSENT")
SQL_ACTIVE = "ERROR: An active erasure request already exists for this email"
SQL_SUBMITTED = "SUCCESS: Erasure request submitted with ID: "
SQL_NOT_FOUND = "ERROR: Erasure request not found"
SQL_NOT_PROCESSABLE = "ERROR: Request is not in a processable state. Current status: "
SQL_HOLD = "ERROR: Customer data under legal retention - cannot delete"
SQL_HOLD_BASIS = "Customer data under legal retention - cannot delete"
SQL_NO_ACTIVE = "ERROR: No active erasure request found for customer"
SQL_COORDINATED = ("SUCCESS: Third-party coordination initiated for: GOOGLE_ANALYTICS, MAILCHIMP, SALESFORCE, "
                   "STRIPE, ZENDESK, ")
BATCH_REASONS = VALID_REASONS + ["JUST_BECAUSE"]


# --- submission ---------------------------------------------------------------

def candidates(m):
    """A submission batch derived from the data: every customer who withdrew
    marketing consent submits once (reason drawn by key, one in seven
    invalid); every fifth of them submits a second time."""
    c = m["customers"].where(F.col("consent_marketing") == F.lit(False))
    k = F.substring("customer_id", 6, 20).cast("long")
    reasons = F.array(*[F.lit(r) for r in BATCH_REASONS])
    first = c.select(F.col("email").alias("customer_email"),
                     F.element_at(reasons, (k % 7 + 1).cast("int")).alias("erasure_reason"),
                     F.lit(1).cast("long").alias("submission_seq"))
    second = c.where(k % 5 == 0).select(F.col("email").alias("customer_email"),
                                        F.lit("OBJECTION").alias("erasure_reason"),
                                        F.lit(2).cast("long").alias("submission_seq"))
    return first.unionByName(second)


CANDIDATES_SQL = """
SELECT email AS customer_email,
       (['WITHDRAWN_CONSENT', 'NO_LONGER_NECESSARY', 'UNLAWFUL_PROCESSING', 'OBJECTION', 'LEGAL_COMPLIANCE',
         'CHILD_CONSENT', 'JUST_BECAUSE'])[CAST(substr(customer_id, 6) AS BIGINT) % 7 + 1] AS erasure_reason,
       CAST(1 AS BIGINT) AS submission_seq
FROM px_customers WHERE consent_marketing = FALSE
UNION ALL
SELECT email, 'OBJECTION', CAST(2 AS BIGINT) FROM px_customers
WHERE consent_marketing = FALSE AND CAST(substr(customer_id, 6) AS BIGINT) % 5 = 0"""

SUBMIT_SQL = f"""
SELECT *,
       CASE WHEN outcome = 'ACCEPTED' THEN request_id_ END AS request_id,
       CASE WHEN outcome = 'ACCEPTED' THEN cid END AS customer_id,
       CASE WHEN outcome = 'INVALID_REASON' THEN '{SQL_BAD_REASON}'
            WHEN outcome = 'ACTIVE_REQUEST_EXISTS' THEN '{SQL_ACTIVE}'
            ELSE '{SQL_SUBMITTED}' || request_id_ END AS message,
       CASE WHEN outcome = 'ACCEPTED' THEN DATE '2001-08-01' + 30 END AS estimated_completion_date
FROM (
  SELECT c.customer_email, c.erasure_reason, 'API' AS request_source, c.submission_seq,
         CASE WHEN c.erasure_reason IS NULL OR c.erasure_reason NOT IN ({VALID_SQL}) THEN 'INVALID_REASON'
              WHEN o.customer_email IS NOT NULL THEN 'ACTIVE_REQUEST_EXISTS'
              WHEN c.submission_seq <> f.f THEN 'ACTIVE_REQUEST_EXISTS'
              ELSE 'ACCEPTED' END AS outcome,
         'REQ_2001_' || substr(sha256(concat_ws('|', c.customer_email, c.erasure_reason,
                                                CAST(c.submission_seq AS VARCHAR), '2001-08-01',
                                                CAST(coalesce(e.n, 0) AS VARCHAR))), 1, 32)
           AS request_id_,
         l.customer_id AS cid
  FROM cand c
  LEFT JOIN (SELECT customer_email, count(*) AS n FROM px_erasure_requests GROUP BY customer_email) e
    ON e.customer_email = c.customer_email
  LEFT JOIN (SELECT DISTINCT customer_email FROM px_erasure_requests WHERE status IN {OPEN}) o
    ON o.customer_email = c.customer_email
  LEFT JOIN (SELECT customer_email, min(submission_seq) AS f FROM cand
             WHERE erasure_reason IN ({VALID_SQL}) GROUP BY customer_email) f
    ON f.customer_email = c.customer_email
  LEFT JOIN (SELECT email, customer_id FROM px_customers WHERE is_deleted = FALSE) l
    ON l.email = c.customer_email)"""


@register("submit_requests", canon_sql(
    with_tables("px_customers", "px_erasure_requests", cand=CANDIDATES_SQL)
    + f"SELECT * EXCLUDE (request_id_, cid) FROM ({SUBMIT_SQL})", ["estimated_completion_date"]))
def submit_requests(m):
    """A batch of submissions validated against reasons and open requests."""
    from ..sources.derived import gdpr_config
    days = Q.config_value(gdpr_config(m.spark), "MAX_RESPONSE_TIME_DAYS").cast("int")
    return Q.submit_requests(candidates(m), m["customers"], m["erasure_requests"], AS_OF, days)


# --- processing plan ------------------------------------------------------------

def to_process(m):
    """Every stored request id plus ids that do not exist (derived keys)."""
    ghosts = (m.tables["orders"].where((F.col("o_orderkey") % 11 == 1) & (F.col("o_orderkey") % 13 == 0))
              .select(F.concat(F.lit("REQ_"), F.col("o_orderkey").cast("string")).alias("request_id")))
    return m["erasure_requests"].select("request_id").unionByName(ghosts)


HOLDS_SQL = """
SELECT c.email AS customer_email, count(*) AS hold_count
FROM px_retention_policies rp JOIN px_customers c ON c.customer_id = rp.customer_id
WHERE rp.retention_end_date > DATE '2001-08-01' AND rp.can_override_gdpr = FALSE
GROUP BY c.email"""
TO_PROCESS_SQL = """
SELECT request_id FROM px_erasure_requests
UNION ALL
SELECT 'REQ_' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 11 = 1 AND o_orderkey % 13 = 0"""
PLAN_SQL = f"""
SELECT t.request_id, r.customer_email, r.status, coalesce(h.hold_count, 0) AS hold_count,
       CASE WHEN r.customer_email IS NULL THEN 'NOT_FOUND'
            WHEN r.status NOT IN ('SUBMITTED', 'VALIDATED') THEN 'NOT_PROCESSABLE'
            WHEN coalesce(h.hold_count, 0) > 0 THEN 'REJECTED'
            ELSE 'IN_PROGRESS' END AS decision,
       CASE WHEN r.customer_email IS NULL THEN '{SQL_NOT_FOUND}'
            WHEN r.status NOT IN ('SUBMITTED', 'VALIDATED') THEN '{SQL_NOT_PROCESSABLE}' || r.status
            WHEN coalesce(h.hold_count, 0) > 0 THEN '{SQL_HOLD}' END AS message
FROM to_process t
LEFT JOIN px_erasure_requests r ON r.request_id = t.request_id
LEFT JOIN holds h ON h.customer_email = r.customer_email"""

PLAN_TABLES = ("px_customers", "px_erasure_requests", "px_retention_policies")


def _plan_with(*more, **extra):
    return with_tables(*PLAN_TABLES, *more, to_process=TO_PROCESS_SQL, holds=HOLDS_SQL,
                       plan=PLAN_SQL,
                       erase="SELECT DISTINCT customer_email FROM plan WHERE decision = 'IN_PROGRESS'",
                       **extra)


def plan(m):
    return Q.process_plan(to_process(m), m["erasure_requests"], m["retention_policies"],
                          m["customers"], AS_OF)


@register("process_plan", _plan_with() + "SELECT * FROM plan")
def process_plan(m):
    """Decision per request id: not found, not processable, held, or go."""
    return plan(m)


@register("request_status_update", canon_sql(_plan_with() + f"""
SELECT r.request_id,
       CASE WHEN p.decision IN ('REJECTED', 'IN_PROGRESS') THEN p.decision ELSE r.status END AS status,
       CASE WHEN p.decision = 'REJECTED' THEN '{SQL_HOLD_BASIS}' END AS legal_basis_override,
       CASE WHEN p.decision = 'IN_PROGRESS' THEN TIMESTAMP '2001-08-01 00:00:00' END AS started_at
FROM px_erasure_requests r
LEFT JOIN (SELECT request_id, decision FROM plan WHERE decision IN ('REJECTED', 'IN_PROGRESS')) p
  ON p.request_id = r.request_id""", ["started_at"]))
def request_status_update(m):
    """Requests after the plan's status changes are applied."""
    return Q.apply_decisions(m["erasure_requests"], plan(m), AS_OF).select(
        "request_id", "status", "legal_basis_override", "started_at")


# --- erasure ----------------------------------------------------------------------

def erase_set(m):
    return X.subjects_to_erase(plan(m))


HELD_SQL = ("coalesce(can_be_deleted = FALSE OR legal_retention_until > DATE '2001-08-01', FALSE)")
DELETE_TABLES = [("customers", "px_customers", "customer_id", "email", False),
                 ("orders", "px_orders", "order_id", "customer_email", True),
                 ("support_tickets", "px_support_tickets", "ticket_id", "customer_email", False),
                 ("marketing_interactions", "px_marketing_interactions", "interaction_id",
                  "customer_email", False)]


def _kept_sql(px, idc, col, held):
    gone = f"{col} IN (SELECT customer_email FROM erase)"
    if held:
        gone += f" AND NOT {HELD_SQL}"
    return f"SELECT '{px[3:]}' AS table_name, {idc} AS row_id FROM {px} WHERE NOT coalesce({gone}, FALSE)"


@register("erase_delete", _plan_with(*[t[1] for t in DELETE_TABLES]) + "\nUNION ALL\n".join(
    _kept_sql(px, idc, col, held) for _, px, idc, col, held in DELETE_TABLES))
def erase_delete(m):
    """Rows kept in each DELETE table after erasing the approved subjects
    (order-level legal holds honoured)."""
    subj = erase_set(m)
    out = None
    for name, _, idc, col, _ in DELETE_TABLES:
        kept, _ = X.erase_delete(m[name], subj, AS_OF, honour_row_holds=True)
        part = kept.select(F.lit(name).alias("table_name"), F.col(idc).alias("row_id"))
        out = part if out is None else out.unionByName(part)
    return out


@register("erase_files", _plan_with(*[t[1] for t in DELETE_TABLES]) + "\nUNION ALL\n".join(
    _kept_sql(px, idc, col, held) for _, px, idc, col, held in DELETE_TABLES))
def erase_files(m):
    """The same on kept tables, of which only the files that hold a subject are rewritten."""
    from ..sources.state import StateFolder
    state, subj, out = StateFolder(m.spark, scratch_path(m.spark, "files")), erase_set(m), None
    for name, _, _, col, _ in DELETE_TABLES:  # kept in order of the e-mail: a subject's rows are in few files
        state.stage(name, m[name].repartitionByRange(64, col))
    state.commit([name for name, *_ in DELETE_TABLES])
    for name, _, _, col, _ in DELETE_TABLES:
        X.rewrite_files(state, name, lambda t, c=col: X.mark_rows(t, subj, "DELETE", AS_OF, cols=[c]), subj, "DELETE", "", [col])
    state.commit()
    for name, _, idc, _, _ in DELETE_TABLES:
        part = state.read(name).select(F.lit(name).alias("table_name"), F.col(idc).alias("row_id"))
        out = part if out is None else out.unionByName(part)
    return out


def _pseudo_sql(col):
    return f"'PSEUDONYM_' || sha256('{SALT}' || {col})"


@register("erase_pseudonymize", _plan_with("px_user_activities") + f"""
SELECT event_id,
       CASE WHEN hit THEN {_pseudo_sql('user_email')} ELSE user_email END AS user_email,
       CASE WHEN hit THEN TRUE ELSE is_pseudonymized END AS is_pseudonymized,
       CASE WHEN hit THEN 'PID_' || substr(sha256('{SALT}|id|' || user_email), 1, 16)
            ELSE pseudonym_id END AS pseudonym_id
FROM (SELECT *, coalesce(user_email IN (SELECT customer_email FROM erase), FALSE) AS hit
      FROM px_user_activities)""")
def erase_pseudonymize(m):
    """Activities with the approved subjects pseudonymized (salted hash)."""
    t, _ = X.erase_pseudonymize(m["user_activities"], erase_set(m), SALT)
    return t.select("event_id", "user_email", "is_pseudonymized", "pseudonym_id")


ANALYTICS_TABLES = [("user_activities", "event_id", "user_email"),
                    ("marketing_interactions", "interaction_id", "customer_email")]


@register("bulk_pseudonymize", _plan_with("px_user_activities", "px_marketing_interactions", "px_customer_ml_features")
          + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, {i} AS row_id, CASE WHEN {c} IN (SELECT customer_email FROM erase) "
    f"THEN {_pseudo_sql(c)} ELSE {c} END AS person FROM px_{t}" for t, i, c in ANALYTICS_TABLES) + f"""
UNION ALL SELECT 'customer_ml_features', x.feature_id, CASE WHEN c.email IN (SELECT customer_email FROM erase)
       THEN {_pseudo_sql('c.email')} ELSE x.customer_id END
FROM px_customer_ml_features x LEFT JOIN px_customers c USING (customer_id)""")
def bulk_pseudonymize(m):
    """Pseudonymization of every analytics table: by its e-mail column, the features by the customer's key."""
    subj = erase_set(m)
    people = m["customers"].select("customer_id", "email")
    owners = X.owners_of(X.mark_rows(people, subj, "PSEUDONYMIZE").where(F.col("__subject").isNotNull()), "customer_id")
    features = X.next_rows(X.mark_by_key(m["customer_ml_features"].select("feature_id", "customer_id"), "customer_id", owners),
                           ["feature_id", "customer_id"], "PSEUDONYMIZE", SALT, [], "customer_id").select(
        F.lit("customer_ml_features").alias("table_name"), F.col("feature_id").alias("row_id"), F.col("customer_id").alias("person"))
    parts = [X.erase_pseudonymize(m[t].select(i, c), subj, SALT)[0].select(
        F.lit(t).alias("table_name"), F.col(i).alias("row_id"), F.col(c).alias("person")) for t, i, c in ANALYTICS_TABLES]
    return parts[0].unionByName(parts[1]).unionByName(features)


AFFECTED_SQL = "\nUNION ALL\n".join([
    "SELECT 'CUSTOMER_DATA_DB' AS target_database, 'CORE' AS target_schema, 'CUSTOMERS' AS target_table, "
    "'DELETE' AS operation_type, email AS e FROM px_customers",
    "SELECT 'CUSTOMER_DATA_DB', 'TRANSACTIONS', 'ORDERS', 'DELETE', customer_email FROM px_orders "
    f"WHERE NOT {HELD_SQL}",
    "SELECT 'CUSTOMER_DATA_DB', 'SUPPORT', 'SUPPORT_TICKETS', 'DELETE', customer_email FROM px_support_tickets",
    "SELECT 'ANALYTICS_DB', 'EVENTS', 'USER_ACTIVITIES', 'PSEUDONYMIZE', user_email FROM px_user_activities",
    "SELECT 'ANALYTICS_DB', 'CAMPAIGNS', 'MARKETING_INTERACTIONS', 'DELETE', customer_email "
    "FROM px_marketing_interactions",
    # tables without an e-mail: along the keys of the rows that are erased
    "SELECT 'CUSTOMER_DATA_DB', 'PREFERENCES', 'USER_PREFERENCES', 'DELETE', c.email "
    "FROM px_user_preferences x JOIN px_customers c USING (customer_id)",
    "SELECT 'CUSTOMER_DATA_DB', 'TRANSACTIONS', 'ORDER_ITEMS', 'DELETE', o.customer_email "
    f"FROM px_order_items x JOIN px_orders o USING (order_id) WHERE NOT {HELD_SQL}",
    "SELECT 'ANALYTICS_DB', 'ML_MODELS', 'CUSTOMER_ML_FEATURES', 'PSEUDONYMIZE', c.email "
    "FROM px_customer_ml_features x JOIN px_customers c USING (customer_id)"])
OPLOG_SQL = """
SELECT 'OP_' || substr(sha256(concat_ws('|', p.request_id, a.target_database, a.target_schema,
                                        a.target_table)), 1, 24) AS operation_id,
       p.request_id, a.operation_type, a.target_database, a.target_schema, a.target_table,
       'SUCCESS' AS operation_status, a.records_affected, CAST(NULL AS VARCHAR) AS error_message
FROM (SELECT target_database, target_schema, target_table, operation_type, e AS customer_email,
             count(*) AS records_affected
      FROM affected_rows WHERE e IN (SELECT customer_email FROM erase) GROUP BY ALL) a
JOIN (SELECT request_id, customer_email FROM plan WHERE decision = 'IN_PROGRESS') p
  ON p.customer_email = a.customer_email"""
OP_TABLES = ("px_orders", "px_support_tickets", "px_user_activities", "px_marketing_interactions",
             "px_user_preferences", "px_order_items", "px_customer_ml_features")


def op_log(m, decided=None):
    """The operation log of the plan ``decided`` (written once: it feeds every table's job)."""
    decided = decided if decided is not None else materialize(plan(m), "plan")
    planned = X.plan_erasure(m, X.subjects_to_erase(decided), AS_OF, SALT)
    reqs = decided.where(F.col("decision") == "IN_PROGRESS").select("request_id", "customer_email")
    return X.operation_log(planned, reqs)


@register("operation_log", _plan_with(*OP_TABLES, affected_rows=AFFECTED_SQL) + OPLOG_SQL)
def operation_log(m):
    """Per (request, table): operation, status and rows affected."""
    return op_log(m)


SUMMARY_SQL = """
SELECT request_id, '{' || string_agg('"' || target_database || '.' || target_schema || '.'
                                      || target_table || '":' || CAST(records_affected AS VARCHAR),
                                      ',' ORDER BY target_database || '.' || target_schema || '.'
                                      || target_table) || '}' AS deletion_summary
FROM oplog GROUP BY request_id"""


@register("deletion_summary", _plan_with(*OP_TABLES, affected_rows=AFFECTED_SQL, oplog=OPLOG_SQL)
          + SUMMARY_SQL)
def deletion_summary(m):
    """Per request: object of table → rows affected."""
    return X.deletion_summary(op_log(m))


@register("complete_requests", canon_sql(
    _plan_with(*OP_TABLES, affected_rows=AFFECTED_SQL, oplog=OPLOG_SQL, summary=SUMMARY_SQL) + """
SELECT r.request_id, r.customer_email, 'COMPLETED' AS status,
       TIMESTAMP '2001-08-01 00:00:00' AS completed_at, DATE '2001-08-01' AS actual_completion_date,
       coalesce(s.deletion_summary, '{}') AS deletion_summary,
       sha256(r.customer_email || '2001-08-01 00:00:00') AS verification_hash
FROM px_erasure_requests r JOIN plan p ON p.request_id = r.request_id AND p.decision = 'IN_PROGRESS'
LEFT JOIN summary s ON s.request_id = r.request_id""",
    ["completed_at", "actual_completion_date"]))
def complete_requests(m):
    """Requests closed after their erasure ran without a failed table, also
    those whose subject had no rows."""
    decided = materialize(plan(m), "plan")
    return Q.complete_requests(m["erasure_requests"], op_log(m, decided), AS_OF,
                               decided.where(F.col("decision") == "IN_PROGRESS"))


HOLDING_SQL = "\nUNION ALL\n".join(
    f"SELECT '{d}' AS target_database, '{sc}' AS target_schema, '{t}' AS target_table, {c} AS e FROM px_{t.lower()}"
    for d, sc, t, c in [("CUSTOMER_DATA_DB", "CORE", "CUSTOMERS", "email"),
                        ("CUSTOMER_DATA_DB", "TRANSACTIONS", "ORDERS", "customer_email"),
                        ("CUSTOMER_DATA_DB", "SUPPORT", "SUPPORT_TICKETS", "customer_email"),
                        ("ANALYTICS_DB", "EVENTS", "USER_ACTIVITIES", "user_email"),
                        ("ANALYTICS_DB", "CAMPAIGNS", "MARKETING_INTERACTIONS", "customer_email")])


@register("operation_type", _plan_with(*OP_TABLES, holding=HOLDING_SQL) + """
SELECT DISTINCT target_database, target_schema, target_table,
       CASE WHEN target_database = 'ANALYTICS_DB' AND target_schema IN ('EVENTS', 'ML_MODELS')
            THEN 'PSEUDONYMIZE' ELSE 'DELETE' END AS operation
FROM holding WHERE e IN (SELECT customer_email FROM erase)""")
def operation_type(m):
    """Operation chosen for each table holding approved subjects' rows."""
    found = D.discover_subjects(m, erase_set(m), databases=X.ERASURE_DATABASES)
    return (found.select(F.col("database_name").alias("target_database"), F.col("schema_name").alias("target_schema"),
                         F.col("table_name").alias("target_table")).distinct()
            .withColumn("operation", C.operation_type("target_database", "target_schema")))


# --- verification ---------------------------------------------------------------

def verify_counts(m):
    """Every e-mail column labelled as one, and every key that leads to a table without, in
    every table the erasure rewrites; one pass a table."""
    subj = erase_set(m)
    return X.verify_planned(X.plan_erasure(m, subj, AS_OF, SALT), m, X.scope_from_classification(m["data_classification"]))


COUNTS_SQL = f"""
SELECT coalesce(b.t, a.t) AS table_name, coalesce(b.e, a.e) AS customer_email,
       coalesce(b.n, 0) AS records_before, coalesce(a.n, 0) AS records_after
FROM (SELECT t, e, count(*) AS n FROM before_rows WHERE e IN (SELECT customer_email FROM erase)
      GROUP BY ALL) b
FULL OUTER JOIN (SELECT t, e, count(*) AS n FROM after_rows
                 WHERE e IN (SELECT customer_email FROM erase) GROUP BY ALL) a
  ON a.t = b.t AND a.e = b.e"""
BEFORE_SQL = """
SELECT 'CUSTOMER_DATA_DB.CORE.CUSTOMERS' AS t, email AS e FROM px_customers
UNION ALL SELECT 'CUSTOMER_DATA_DB.TRANSACTIONS.ORDERS', customer_email FROM px_orders
UNION ALL SELECT 'CUSTOMER_DATA_DB.SUPPORT.SUPPORT_TICKETS', customer_email FROM px_support_tickets
UNION ALL SELECT 'ANALYTICS_DB.CAMPAIGNS.MARKETING_INTERACTIONS', customer_email FROM px_marketing_interactions
UNION ALL SELECT 'ANALYTICS_DB.EVENTS.USER_ACTIVITIES', user_email FROM px_user_activities
UNION ALL SELECT target_database || '.' || target_schema || '.' || target_table, e FROM affected_rows
WHERE target_table IN ('USER_PREFERENCES', 'ORDER_ITEMS', 'CUSTOMER_ML_FEATURES')"""
AFTER_SQL = f"""
SELECT 'CUSTOMER_DATA_DB.CORE.CUSTOMERS' AS t, email AS e FROM px_customers
WHERE NOT coalesce(email IN (SELECT customer_email FROM erase), FALSE)
UNION ALL SELECT 'CUSTOMER_DATA_DB.TRANSACTIONS.ORDERS', customer_email FROM px_orders
WHERE NOT coalesce(customer_email IN (SELECT customer_email FROM erase) AND NOT {HELD_SQL}, FALSE)
UNION ALL SELECT 'CUSTOMER_DATA_DB.SUPPORT.SUPPORT_TICKETS', customer_email FROM px_support_tickets
WHERE NOT coalesce(customer_email IN (SELECT customer_email FROM erase), FALSE)
UNION ALL SELECT 'ANALYTICS_DB.CAMPAIGNS.MARKETING_INTERACTIONS', customer_email FROM px_marketing_interactions
WHERE NOT coalesce(customer_email IN (SELECT customer_email FROM erase), FALSE)
UNION ALL SELECT 'ANALYTICS_DB.EVENTS.USER_ACTIVITIES',
       CASE WHEN user_email IN (SELECT customer_email FROM erase)
            THEN {_pseudo_sql('user_email')} ELSE user_email END
FROM px_user_activities"""


def _verify_with(**extra):
    return _plan_with(*OP_TABLES, affected_rows=AFFECTED_SQL, before_rows=BEFORE_SQL,
                      after_rows=AFTER_SQL, counts=COUNTS_SQL, **extra)


VERIFIED_SQL = """
SELECT *, (records_before > 0 AND records_after = 0) OR (records_before = 0 AND records_after = 0)
          AS deletion_verified
FROM counts WHERE records_before > 0 OR records_after > 0"""


@register("verify_join", _verify_with() + "SELECT * FROM counts")
def verify_join(m):
    """Per (table, subject) row counts before and after, signed and added up in one aggregate."""
    return verify_counts(m)


@register("verify_deletion", _verify_with() + VERIFIED_SQL
          + "\nORDER BY deletion_verified ASC, records_before DESC")
def verify_deletion(m):
    """Deletion verified per (table, subject), unverified first."""
    return X.verify_deletion(verify_counts(m))


@register("sort_verify", _verify_with() + f"""
SELECT table_name, customer_email, deletion_verified, records_before FROM ({VERIFIED_SQL})
ORDER BY deletion_verified ASC, records_before DESC""")
def sort_verify(m):
    """Verification rows, unverified first, then by rows before."""
    return X.verify_deletion(verify_counts(m)).select(
        "table_name", "customer_email", "deletion_verified", "records_before")


@register("verify_all", _verify_with(verified=VERIFIED_SQL) + """
SELECT customer_email, bool_and(deletion_verified) AS all_verified,
       coalesce(string_agg(CASE WHEN NOT deletion_verified THEN table_name END, ','
                           ORDER BY CASE WHEN NOT deletion_verified THEN table_name END), '')
         AS failed_tables,
       count(*) FILTER (WHERE NOT deletion_verified) AS failed_count
FROM verified GROUP BY customer_email""")
def verify_all(m):
    """Per subject: every table verified, and which failed."""
    return X.verify_all(X.verify_deletion(verify_counts(m)))


# --- processors -------------------------------------------------------------------

PROCESSORS_SQL = "('GOOGLE_ANALYTICS'), ('MAILCHIMP'), ('SALESFORCE'), ('STRIPE'), ('ZENDESK')"
LATEST_ACTIVE_SQL = """
SELECT customer_email, request_id FROM px_erasure_requests
WHERE status IN ('IN_PROGRESS', 'COMPLETED')
QUALIFY row_number() OVER (PARTITION BY customer_email ORDER BY requested_at DESC, request_id DESC) = 1"""
NOTIF_SQL = f"""
SELECT 'NOTIF_' || substr(sha256(concat_ws('|', l.request_id, p.p)), 1, 24) AS notification_id,
       l.request_id, l.customer_email, p.p AS third_party_name, 'PROCESSOR' AS third_party_type,
       'DELETION_REQUEST' AS notification_type, 'API' AS method, 'PENDING' AS status
FROM lat l, (VALUES {PROCESSORS_SQL}) AS p(p)"""


def notifications(m):
    return Q.coordinate_processors(m["erasure_requests"].select("customer_email"),
                                   m["erasure_requests"], AS_OF)


@register("coordinate_processors", with_tables("px_erasure_requests", lat=LATEST_ACTIVE_SQL) + NOTIF_SQL)
def coordinate_processors(m):
    """Processor notifications for every subject's newest active request."""
    return notifications(m).select("notification_id", "request_id", "customer_email",
                                   "third_party_name", "third_party_type", "notification_type",
                                   "method", "status")


@register("processor_cross", with_tables("px_erasure_requests", lat=LATEST_ACTIVE_SQL,
                                         notif=NOTIF_SQL) + """
SELECT third_party_name, count(*) AS notifications FROM notif GROUP BY third_party_name""")
def processor_cross(m):
    """Request × processor expansion, counted per processor."""
    return notifications(m).groupBy("third_party_name").agg(F.count(F.lit(1)).alias("notifications"))


@register("pending_notifications", with_tables("px_erasure_requests", lat=LATEST_ACTIVE_SQL,
                                               notif=NOTIF_SQL) + """
SELECT customer_email, third_party_name AS external_system_name, status AS notification_status
FROM notif WHERE status = 'PENDING'""")
def pending_notifications(m):
    """The processor outbox: notifications still PENDING."""
    from ..plans.reports import pending_notifications as pending
    return pending(notifications(m)).select("customer_email", "external_system_name",
                                            "notification_status")


@register("coordination_outcome", with_tables("px_customers", "px_erasure_requests",
                                              lat=LATEST_ACTIVE_SQL) + f"""
SELECT s.customer_email, l.request_id,
       CASE WHEN l.request_id IS NULL THEN '{SQL_NO_ACTIVE}'
            ELSE '{SQL_COORDINATED}'
       END AS message
FROM (SELECT DISTINCT email AS customer_email FROM px_customers) s
LEFT JOIN lat l USING (customer_email)""")
def coordination_outcome(m):
    """Coordination result per customer (error when no active request)."""
    return Q.coordination_outcome(m["customers"].select(F.col("email").alias("customer_email")),
                                  m["erasure_requests"])


# --- subject status ---------------------------------------------------------------

STATUS_SQL = f"""
SELECT s.email AS customer_email, coalesce(a.has_active, FALSE) AS has_active_request,
       a.last_request_date, coalesce(a.completed, FALSE) AS deletion_completed,
       c.data_retention_until, CAST(c.consent_marketing AS VARCHAR) AS marketing,
       CAST(c.consent_analytics AS VARCHAR) AS analytics, c.consent_given_date
FROM (SELECT DISTINCT email FROM px_customers) s
LEFT JOIN (SELECT customer_email, count(*) FILTER (WHERE status IN {OPEN}) > 0 AS has_active,
                  max(requested_at) AS last_request_date,
                  count(*) FILTER (WHERE status = 'COMPLETED') > 0 AS completed
           FROM px_erasure_requests GROUP BY customer_email) a ON a.customer_email = s.email
LEFT JOIN (SELECT * FROM px_customers WHERE is_deleted = FALSE) c ON c.email = s.email"""


@register("subject_status", canon_sql(with_tables("px_customers", "px_erasure_requests") + STATUS_SQL,
                                      ["last_request_date", "data_retention_until",
                                       "consent_given_date"]))
def subject_status(m):
    """Compliance status of every customer (the status function, in bulk)."""
    st = Q.subject_status(m["customers"].select(F.col("email").alias("customer_email")),
                          m["erasure_requests"], m["customers"])
    # consents are NULL without a live record: shown as text (true/false/NULL)
    return st.withColumn("marketing", F.col("marketing").cast("string")) \
             .withColumn("analytics", F.col("analytics").cast("string"))


@register("semi_has_request", with_tables("px_customers", "px_erasure_requests") + f"""
SELECT customer_id, email FROM px_customers c
WHERE EXISTS (SELECT 1 FROM px_erasure_requests r WHERE r.customer_email = c.email AND r.status IN {OPEN})
  AND NOT EXISTS (SELECT 1 FROM px_erasure_requests r WHERE r.customer_email = c.email
                  AND r.status = 'COMPLETED')""")
def semi_has_request(m):
    """Customers with an open request and no completed one (EXISTS as a
    left-semi join, NOT EXISTS as a left-anti join)."""
    r = m["erasure_requests"]
    c = m["customers"].select("customer_id", "email")
    open_ = r.where(F.col("status").isin(C.OPEN_STATES)).select(F.col("customer_email").alias("e")).distinct()
    done = r.where(F.col("status") == "COMPLETED").select(F.col("customer_email").alias("e")).distinct()
    return (c.join(open_, c["email"] == open_["e"], "left_semi")
             .join(done, c["email"] == done["e"], "left_anti"))


@register("scalar_lookup", canon_sql(with_tables("px_customers", "px_erasure_requests") + """
SELECT s.customer_email,
       (SELECT max(requested_at) FROM px_erasure_requests r WHERE r.customer_email = s.customer_email)
         AS last_request_date,
       (SELECT data_retention_until FROM px_customers c
        WHERE c.email = s.customer_email AND c.is_deleted = FALSE) AS data_retention_until
FROM (SELECT DISTINCT customer_email FROM px_erasure_requests) s""",
    ["last_request_date", "data_retention_until"]))
def scalar_lookup(m):
    """Scalar subqueries per subject as left joins to per-key aggregates."""
    s = m["erasure_requests"].select("customer_email").distinct()
    st = Q.subject_status(s, m["erasure_requests"], m["customers"])
    return st.select("customer_email", "last_request_date", "data_retention_until")


# --- audit ------------------------------------------------------------------------

def audit_events(m):
    r = m["erasure_requests"].where(F.col("status") == "SUBMITTED")
    return r.select(
        F.lit("ERASURE_REQUEST_SUBMITTED").alias("event_type"), "customer_email",
        F.concat(F.lit("Erasure request submitted with reason: "), F.col("erasure_reason"))
         .alias("event_description"),
        F.concat(F.lit('{"request_id": "'), F.col("request_id"), F.lit('", "reason": "'),
                 F.col("erasure_reason"), F.lit('"}')).alias("event_data"),
        F.col("requested_at").alias("event_timestamp"))


AUDIT_EVENTS_SQL = """
SELECT 'ERASURE_REQUEST_SUBMITTED' AS event_type, customer_email,
       'Erasure request submitted with reason: ' || erasure_reason AS event_description,
       '{"request_id": "' || request_id || '", "reason": "' || erasure_reason || '"}' AS event_data,
       requested_at AS event_timestamp
FROM px_erasure_requests WHERE status = 'SUBMITTED'"""
AUDIT_ROWS_SQL = """
SELECT *, sha256(audit_id || event_type || customer_email || CAST(event_timestamp AS VARCHAR)) AS audit_hash
FROM (SELECT 'AUDIT_' || substr(sha256(concat_ws('|', event_type, customer_email,
                                                 CAST(event_timestamp AS VARCHAR), event_description,
                                                 event_data)), 1, 32) AS audit_id, *
      FROM ev)"""


@register("audit_append", canon_sql(with_tables("px_erasure_requests", ev=AUDIT_EVENTS_SQL) + """
SELECT audit_id, event_type, event_timestamp, customer_email, 'SYSTEM' AS user_name,
       'GDPR_ADMIN' AS role_name, event_description, event_data, audit_hash
FROM (""" + AUDIT_ROWS_SQL + ")", ["event_timestamp"]))
def audit_append(m):
    """Audit rows (with hash) for every submitted request."""
    return Q.audit_append(audit_events(m)).select(
        "audit_id", "event_type", "event_timestamp", "customer_email", "user_name", "role_name",
        "event_description", "event_data", "audit_hash")


@register("audit_verify", with_tables("px_erasure_requests", ev=AUDIT_EVENTS_SQL) + """
SELECT audit_id, customer_email, audit_hash,
       audit_hash = sha256(audit_id || event_type || customer_email || CAST(event_timestamp AS VARCHAR))
         AS hash_matches
FROM (""" + AUDIT_ROWS_SQL + ")")
def audit_verify(m):
    """Stored audit hashes recomputed and compared."""
    return Q.audit_verify(Q.audit_append(audit_events(m)))


# --- key checks and scans ---------------------------------------------------------

FK = [("orders", "customer_id", "customers", "customer_id"),
      ("order_items", "order_id", "orders", "order_id"),
      ("support_tickets", "customer_id", "customers", "customer_id"),
      ("user_preferences", "customer_id", "customers", "customer_id"),
      ("retention_policies", "customer_id", "customers", "customer_id"),
      ("user_activities", "customer_id", "customers", "customer_id"),
      ("marketing_interactions", "customer_id", "customers", "customer_id"),
      ("customer_ml_features", "customer_id", "customers", "customer_id"),
      ("erasure_requests", "customer_id", "customers", "customer_id"),
      ("data_discovery_results", "request_id", "erasure_requests", "request_id"),
      ("erasure_operations", "request_id", "erasure_requests", "request_id"),
      ("third_party_notifications", "request_id", "erasure_requests", "request_id")]


# A parent that stays: customers not deleted, orders that must be kept, requests still open.
LIVE_SQL = {"customers": "is_deleted = FALSE", "orders": "can_be_deleted = FALSE", "erasure_requests": f"status IN {OPEN}"}
#: Tables the workflow makes: discovery results, operations and notifications of requests.
MADE = ("data_discovery_results", "erasure_operations", "third_party_notifications")


def _made(m) -> dict:
    from .q_discovery import discovery_results
    return {"data_discovery_results": discovery_results(m), "erasure_operations": op_log(m), "third_party_notifications": notifications(m)}


def _fk_sql() -> str:
    from .q_discovery import DISCOVERED_SQL, LONG_SQL
    found = ("SELECT r.request_id FROM discovered d JOIN px_erasure_requests r ON r.customer_email = d.customer_email")
    return _plan_with(*OP_TABLES, "px_audit_log", affected_rows=AFFECTED_SQL, long=LONG_SQL, discovered=DISCOVERED_SQL, lat=LATEST_ACTIVE_SQL,
                      px_data_discovery_results=found, px_erasure_operations=OPLOG_SQL, px_third_party_notifications=NOTIF_SQL) + \
        "\nUNION ALL\n".join(
            f"SELECT '{c}' AS child_table, '{fc}' AS fk_column, "
            f"count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM px_{p} y WHERE y.{pc} = x.{fc})) AS orphan_rows, "
            f"count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM px_{p} y WHERE y.{pc} = x.{fc} AND y.{LIVE_SQL[p]})) "
            f"AS rows_without_live_parent FROM px_{c} x" for c, fc, p, pc in FK)


@register("fk_orphans", _fk_sql())
def fk_orphans(m):
    """Child rows whose declared foreign key has no parent, and those that would have none
    once deleted customers, all deletable orders and closed requests are gone."""
    out, made = None, _made(m)
    live_of = {"customers": F.col("is_deleted") == F.lit(False), "orders": F.col("can_be_deleted") == F.lit(False),
               "erasure_requests": F.col("status").isin(C.OPEN_STATES)}
    for c, fc, p, pc in FK:
        parent = m[p].select(F.col(pc).alias("__pk"), F.coalesce(live_of[p], F.lit(False)).alias("__live"))
        parent = parent.groupBy("__pk").agg(F.max("__live").alias("__live"))
        # children are counted per key first (a hot key is combined map-side)
        child = (made[c] if c in MADE else m[c]).groupBy(fc).agg(F.count(F.lit(1)).alias("__n"))
        j = child.join(parent, child[fc] == parent["__pk"], "left")
        part = j.agg(F.coalesce(F.sum(F.when(F.col("__pk").isNull(), F.col("__n"))), F.lit(0)).cast("long").alias("orphan_rows"),
                     F.coalesce(F.sum(F.when(~F.coalesce("__live", F.lit(False)), F.col("__n"))), F.lit(0)).cast("long")
                      .alias("rows_without_live_parent")).select(
            F.lit(c).alias("child_table"), F.lit(fc).alias("fk_column"), "orphan_rows", "rows_without_live_parent")
        out = part if out is None else out.unionByName(part)
    return out


PK = [("customers", "customer_id"), ("orders", "order_id"), ("order_items", "order_item_id"),
      ("support_tickets", "ticket_id"), ("user_activities", "event_id"),
      ("marketing_interactions", "interaction_id"), ("customer_ml_features", "feature_id"),
      ("user_preferences", "preference_id"), ("retention_policies", "policy_id"),
      ("gdpr_audit_log", "audit_id"), ("erasure_requests", "request_id")]
PX = {"gdpr_audit_log": "px_audit_log"}  # names that differ on the oracle side


@register("pk_duplicates", with_tables(*[PX.get(t, f"px_{t}") for t, _ in PK]) + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {PX.get(t, f'px_{t}')}) AS key_rows, count(*) AS duplicate_keys FROM "
    f"(SELECT {k} FROM {PX.get(t, f'px_{t}')} GROUP BY {k} HAVING count(*) > 1)" for t, k in PK))
def pk_duplicates(m):
    """Primary keys that occur more than once, per table, and the rows checked."""
    out = None
    for t, k in PK:
        d = m[t].groupBy(k).agg(F.count(F.lit(1)).alias("n"))
        part = d.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("key_rows"),
                     F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_keys")).select(
            F.lit(t).alias("table_name"), "key_rows", "duplicate_keys")
        out = part if out is None else out.unionByName(part)
    return out


@register("scan_tables", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in DRIVER_SCHEMAS))
def scan_tables(m):
    """Every input table read with its declared schema, counted."""
    out = None
    for t in DRIVER_SCHEMAS:
        part = m.tables[t].agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(t).alias("table_name"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


EXPORT = [("customers", "customer_id", "email"), ("orders", "order_id", "customer_email"),
          ("support_tickets", "ticket_id", "customer_email"), ("user_activities", "event_id", "user_email"),
          ("marketing_interactions", "interaction_id", "customer_email"),
          ("erasure_requests", "request_id", "customer_email"), ("gdpr_audit_log", "audit_id", "customer_email")]
EXPORT_BY_ID = [("user_preferences", "preference_id"), ("retention_policies", "policy_id"),
                ("customer_ml_features", "feature_id")]


@register("export_subject", _plan_with(*OP_TABLES, "px_audit_log", "px_user_preferences", "px_customer_ml_features",
                                       "px_order_items") + "\nUNION ALL\n".join(
    [f"SELECT {c} AS customer_email, '{t}' AS table_name, {i} AS row_id FROM {PX.get(t, f'px_{t}')} "
     f"WHERE {c} IN (SELECT customer_email FROM erase)" for t, i, c in EXPORT]
    + [f"SELECT c.email, '{t}', x.{i} FROM px_{t} x JOIN px_customers c USING (customer_id) "
       f"WHERE c.email IN (SELECT customer_email FROM erase)" for t, i in EXPORT_BY_ID]
    + ["SELECT o.customer_email, 'order_items', x.order_item_id FROM px_order_items x JOIN px_orders o USING (order_id) "
       "WHERE o.customer_email IN (SELECT customer_email FROM erase)"]))
def export_subject(m):
    """Every row of each approved subject in all eleven tables (the data
    export an access request asks for)."""
    return E.export_rows(m, erase_set(m)).select("customer_email", "table_name", "row_id")


#: Fields of the exported records that are compared, as SQL on the derived tables and as JSON fields of the same names.
EXPORT_FIELDS = {"customers": ["first_name", "last_name", "phone_number", "address_line1", "city", "lawful_basis"],
                 "orders": ["customer_id", "payment_method", "order_status", "billing_address"],
                 "support_tickets": ["customer_id", "subject", "description"],
                 "user_activities": ["customer_id", "session_id", "page_url", "ip_address", "event_properties", "pseudonym_id"],
                 "marketing_interactions": ["customer_id", "campaign_name", "interaction_type", "channel"],
                 "erasure_requests": ["customer_id", "erasure_reason", "status"],
                 "gdpr_audit_log": ["customer_id", "event_type", "user_name"],
                 "user_preferences": ["customer_id"], "retention_policies": ["customer_id"],
                 "customer_ml_features": ["customer_id"], "order_items": ["order_id"]}


def _fields_sql(table, alias):
    return " || '|' || ".join(f"coalesce({alias}.{c}, '')" for c in EXPORT_FIELDS[table])


@register("export_documents", _plan_with(*OP_TABLES, "px_audit_log", "px_user_preferences", "px_customer_ml_features",
                                         "px_order_items") + "\nUNION ALL\n".join(
    [f"SELECT x.{c} AS customer_email, '{t}' AS table_name, x.{i} AS row_id, CAST(1 AS BIGINT) AS copies, {_fields_sql(t, 'x')} AS fields "
     f"FROM {PX.get(t, f'px_{t}')} x WHERE x.{c} IN (SELECT customer_email FROM erase)" for t, i, c in EXPORT]
    + [f"SELECT c.email, '{t}', x.{i}, 1, {_fields_sql(t, 'x')} FROM px_{t} x JOIN px_customers c USING (customer_id) "
       f"WHERE c.email IN (SELECT customer_email FROM erase)" for t, i in EXPORT_BY_ID]
    + [f"SELECT o.customer_email, 'order_items', x.order_item_id, 1, {_fields_sql('order_items', 'x')} FROM px_order_items x "
       "JOIN px_orders o USING (order_id) WHERE o.customer_email IN (SELECT customer_email FROM erase)"]))
def export_documents(m):
    """The records inside the written JSON documents of all approved subjects, read back
    (one document a subject, several numbered ones for a large one), with their fields."""
    path = scratch_path(m.spark, "export")
    mark = scratch_mark(m.spark)
    E.write_documents(E.export_documents(E.export_rows(m, erase_set(m))), path)
    release(m.spark, mark)  # only the documents are read from here on
    fields = F.lit(None).cast("string")  # a record is searched for its own table's fields only
    for t, cols in EXPORT_FIELDS.items():
        fields = F.when(F.col("table_name") == t, F.concat_ws(
            "|", *[F.coalesce(F.get_json_object("record", f"$.{c}"), F.lit("")) for c in cols])).otherwise(fields)
    return E.read_documents(m.spark, path).select("customer_email", "table_name", "row_id", "copies", fields.alias("fields"))


# --- end to end -----------------------------------------------------------------

def _scenario_ctes(**extra) -> str:
    from .q_discovery import LONG_SQL
    subj = ("SELECT DISTINCT email AS customer_email FROM px_customers "
            "WHERE consent_marketing = FALSE AND consent_analytics = FALSE")
    submitted = f"""
SELECT s.customer_email,
       CASE WHEN o.customer_email IS NOT NULL THEN 'ACTIVE_REQUEST_EXISTS' ELSE 'ACCEPTED' END AS outcome,
       'REQ_2001_' || substr(sha256(concat_ws('|', s.customer_email, 'WITHDRAWN_CONSENT', '1',
                                              '2001-08-01', CAST(coalesce(e.n, 0) AS VARCHAR))), 1, 32) AS request_id
FROM subj s
LEFT JOIN (SELECT customer_email, count(*) AS n FROM px_erasure_requests GROUP BY customer_email) e USING (customer_email)
LEFT JOIN (SELECT DISTINCT customer_email FROM px_erasure_requests WHERE status IN {OPEN}) o
  USING (customer_email)"""
    plan = """
SELECT a.request_id, a.customer_email,
       CASE WHEN coalesce(h.hold_count, 0) > 0 THEN 'REJECTED' ELSE 'IN_PROGRESS' END AS decision
FROM (SELECT * FROM submitted WHERE outcome = 'ACCEPTED') a
LEFT JOIN holds h USING (customer_email)"""
    requests3 = """
SELECT request_id, customer_email, requested_at, status FROM px_erasure_requests
UNION ALL
SELECT p.request_id, p.customer_email, TIMESTAMP '2001-08-01 00:00:00',
       CASE WHEN p.decision = 'REJECTED' THEN 'REJECTED' ELSE 'COMPLETED' END
FROM sc_plan p"""
    notif = """
SELECT s.customer_email, CAST(5 AS BIGINT) AS notifications
FROM subj s
WHERE EXISTS (SELECT 1 FROM requests3 r WHERE r.customer_email = s.customer_email
              AND r.status IN ('IN_PROGRESS', 'COMPLETED'))"""
    verify = f"""
SELECT e, bool_and((b > 0 AND a = 0) OR (b = 0 AND a = 0)) AS all_verified
FROM (SELECT coalesce(x.t, y.t) AS t, coalesce(x.e, y.e) AS e, coalesce(x.n, 0) AS b, coalesce(y.n, 0) AS a
      FROM (SELECT t, e, count(*) AS n FROM before_rows
            WHERE e IN (SELECT customer_email FROM erase) GROUP BY ALL) x
      FULL OUTER JOIN (SELECT t, e, count(*) AS n FROM after_rows
                       WHERE e IN (SELECT customer_email FROM erase) GROUP BY ALL) y
        ON x.t = y.t AND x.e = y.e)
WHERE b > 0 OR a > 0
GROUP BY e"""
    return with_tables(
        "px_customers", "px_erasure_requests", "px_retention_policies", "px_orders",
        "px_support_tickets", "px_user_activities", "px_marketing_interactions", "px_audit_log",
        "px_user_preferences", "px_order_items", "px_customer_ml_features",
        subj=subj, holds=HOLDS_SQL, long=LONG_SQL, submitted=submitted, sc_plan=plan,
        erase="SELECT DISTINCT customer_email FROM sc_plan WHERE decision = 'IN_PROGRESS'",
        affected_rows=AFFECTED_SQL,
        requests3=requests3, notif=notif, before_rows=BEFORE_SQL, after_rows=AFTER_SQL,
        verify=verify, **extra)


def _full_scenario_sql() -> str:
    return _scenario_ctes() + f"""
SELECT s.customer_email,
       EXISTS (SELECT 1 FROM px_erasure_requests r WHERE r.customer_email = s.customer_email
               AND r.status IN {OPEN}) AS active_before,
       coalesce((SELECT count(*) FROM long l WHERE l.value = s.customer_email), 0) AS records_discovered,
       sb.outcome AS submit_outcome,
       p.decision,
       coalesce(n.notifications, CAST(0 AS BIGINT)) AS notifications,
       CASE WHEN v.all_verified THEN 'VERIFIED' WHEN NOT v.all_verified THEN 'NOT_VERIFIED'
            ELSE 'NOT_ERASED' END AS verification,
       EXISTS (SELECT 1 FROM requests3 r WHERE r.customer_email = s.customer_email
               AND r.status = 'COMPLETED') AS completed_after
FROM subj s
LEFT JOIN submitted sb USING (customer_email)
LEFT JOIN sc_plan p ON p.request_id = sb.request_id
LEFT JOIN notif n USING (customer_email)
LEFT JOIN verify v ON v.e = s.customer_email"""


@register("full_scenario", _full_scenario_sql())
def full_scenario(m):
    """The eight-step erasure scenario for every customer who withdrew both
    consents, summarised per subject."""
    from ..plans.scenario import full_scenario as run, scenario_summary
    c = m["customers"]
    subj = c.where((F.col("consent_marketing") == F.lit(False))
                   & (F.col("consent_analytics") == F.lit(False))).select(
        F.col("email").alias("customer_email"))
    return scenario_summary(run(m, subj, AS_OF, SALT))


@register("scenario_two_batches", _scenario_ctes() + """
SELECT s.customer_email, CAST(regexp_extract(s.customer_email, '^user([0-9]+)@', 1) AS BIGINT) // 12 % 2 AS batch,
       sb.outcome AS submit_outcome,
       (SELECT max(r.status) FROM requests3 r WHERE r.request_id = sb.request_id AND sb.outcome = 'ACCEPTED') AS final_status,
       (SELECT count(*) FROM px_customers c WHERE c.email = s.customer_email
          AND c.email NOT IN (SELECT customer_email FROM erase)) AS customer_rows_left,
       (SELECT count(*) FROM (SELECT DISTINCT target_table FROM affected_rows a
          WHERE a.e = s.customer_email AND a.e IN (SELECT customer_email FROM erase))) AS operations_logged
FROM subj s LEFT JOIN submitted sb USING (customer_email)""")
def scenario_two_batches(m):
    """Two disjoint batches of the scenario on one state, one after the other:
    each subject's request, rows left and logged operations at the end."""
    from ..plans.scenario import full_scenario as run
    from ..session import scratch_path
    from ..sources.state import StateFolder
    state = StateFolder(m.spark, scratch_path(m.spark, "state"))
    c = m["customers"]
    both = c.where((F.col("consent_marketing") == F.lit(False)) & (F.col("consent_analytics") == F.lit(False)))
    # customers who withdrew both consents have keys divisible by 12: every other one
    batch = F.floor(F.substring("customer_id", 6, 20).cast("long") / 12) % 2
    subj = materialize(both.select(F.col("email").alias("customer_email"), batch.cast("long").alias("batch")), "batches")
    first, second = (run(m, subj.where(F.col("batch") == b), AS_OF, SALT, state=state) for b in (0, 1))
    sub = first["submitted"].unionByName(second["submitted"]).select(
        "customer_email", F.col("outcome").alias("submit_outcome"), "request_id")
    requests = state.read("erasure_requests").select("request_id", F.col("status").alias("final_status"))
    left = state.read("customers").groupBy(F.col("email").alias("customer_email")).agg(F.count(F.lit(1)).alias("n"))
    owners = sub.select("customer_email", "request_id")
    ops = (state.read("erasure_operations").where(F.col("operation_status") == "SUCCESS").join(owners, "request_id")
           .groupBy("customer_email").agg(F.count(F.lit(1)).alias("ops")))
    j = (subj.join(sub, "customer_email", "left").join(requests, "request_id", "left")
         .join(left, "customer_email", "left").join(ops, "customer_email", "left"))
    return j.select("customer_email", "batch", "submit_outcome", "final_status",
                    F.coalesce("n", F.lit(0)).cast("long").alias("customer_rows_left"),
                    F.coalesce("ops", F.lit(0)).cast("long").alias("operations_logged"))


@register("scenario_rerun", _scenario_ctes() + f"""
, counts AS (
  SELECT (SELECT count(*) FROM px_erasure_requests) AS base, (SELECT count(*) FROM sc_plan) AS accepted,
         (SELECT count(*) FROM sc_plan WHERE decision = 'IN_PROGRESS') AS done,
         (SELECT count(*) FROM (SELECT DISTINCT e, target_table FROM affected_rows
                                WHERE e IN (SELECT customer_email FROM erase))) AS operations,
         (SELECT count(*) FROM notif) AS told_first,
         -- the second time: who has a request that the first run did not pass on
         (SELECT count(*) FROM (SELECT s.customer_email, count(r.request_id) FILTER (WHERE r.status IN ('IN_PROGRESS', 'COMPLETED'))
                                  + count(DISTINCT p.request_id) AS n
                                FROM subj s LEFT JOIN requests3 r USING (customer_email)
                                LEFT JOIN (SELECT * FROM sc_plan WHERE decision = 'IN_PROGRESS') p USING (customer_email)
                                GROUP BY s.customer_email) WHERE n > 1) AS told_again)
SELECT table_name, n AS row_count, n AS distinct_ids FROM (
  SELECT 'erasure_requests' AS table_name, base + 2 * accepted AS n FROM counts
  UNION ALL SELECT 'erasure_operations', operations FROM counts
  UNION ALL SELECT 'third_party_notifications', 5 * (told_first + told_again) FROM counts
  UNION ALL SELECT 'workflow_audit', 2 * accepted + 2 * done + told_first + told_again FROM counts)""")
def scenario_rerun(m):
    """One batch of the scenario twice on one state: the second time its people submit again, nothing of
    theirs is left to erase, and no id of any kept table comes up twice."""
    from ..plans.scenario import full_scenario as run
    from ..session import scratch_path
    from ..sources.state import StateFolder
    state = StateFolder(m.spark, scratch_path(m.spark, "state"))
    c = m["customers"]
    subj = materialize(c.where((F.col("consent_marketing") == F.lit(False)) & (F.col("consent_analytics") == F.lit(False)))
                       .select(F.col("email").alias("customer_email")), "batch")
    for _ in range(2):
        run(m, subj, AS_OF, SALT, state=state)
    out = None
    for name, key in (("erasure_requests", "request_id"), ("erasure_operations", "operation_id"),
                      ("third_party_notifications", "notification_id"), ("workflow_audit", "audit_id")):
        ids = state.read(name).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        part = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("distinct_ids")).select(
            F.lit(name).alias("table_name"), "row_count", "distinct_ids")
        out = part if out is None else out.unionByName(part)
    return out


# --- tables as of a time, and appends -------------------------------------------

def _history(m):
    """Customers valid from one day before the erasure, the erased ones until it."""
    import datetime as dt
    return X.mark_erased(m["customers"].select("customer_id", "email"), erase_set(m), AS_OF,
                         dt.datetime(2001, 7, 31), dt.datetime(2001, 8, 1))


#: Times the history is read at: before it begins, in its first hour, just before and at the erasure, later.
READ_TIMES = ["2001-07-30 23:59:59", "2001-07-31 01:00:00", "2001-07-31 23:59:59", "2001-08-01 00:00:00", "2001-08-02 00:00:00"]


@register("read_as_of", _plan_with() + f"""
SELECT t.ts AS read_at, c.customer_id, c.email
FROM px_customers c, (VALUES {', '.join(f"('{t}')" for t in READ_TIMES)}) AS t(ts)
WHERE t.ts >= '2001-07-31 00:00:00'
  AND (t.ts < '2001-08-01 00:00:00' OR NOT coalesce(c.email IN (SELECT customer_email FROM erase), FALSE))""")
def read_as_of(m):
    """Customers as they were at several times: none before the history begins, all until
    the erasure, those left from that very moment on."""
    history = materialize(_history(m), "history")
    parts = [X.valid_at(history, t).select(F.lit(t).alias("read_at"), "customer_id", "email") for t in READ_TIMES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("asof_snapshot", _plan_with() + """
SELECT customer_id, email FROM px_customers
WHERE NOT coalesce(email IN (SELECT customer_email FROM erase), FALSE)""")
def asof_snapshot(m):
    """Customers as they are a day after the erasure."""
    import datetime as dt
    return X.valid_at(_history(m), dt.datetime(2001, 8, 2))


@register("append_rows", canon_sql(
    with_tables("px_customers", "px_erasure_requests", cand=CANDIDATES_SQL) + f"""
SELECT request_id, customer_email, status FROM px_erasure_requests
UNION ALL
SELECT request_id, customer_email, 'SUBMITTED' FROM ({SUBMIT_SQL}) WHERE outcome = 'ACCEPTED'"""))
def append_rows(m):
    """Accepted submissions appended to the stored request table (INSERT)."""
    from ..session import scratch_path
    from ..sources.state import StateFolder
    state = StateFolder(m.spark, scratch_path(m.spark, "requests"))
    state.append("erasure_requests", m["erasure_requests"])
    sub = Q.submit_requests(candidates(m), m["customers"], m["erasure_requests"], AS_OF)
    state.append("erasure_requests", Q.accepted_request_rows(sub, AS_OF))
    return state.read("erasure_requests").select("request_id", "customer_email", "status")


def _workflow_audit_sql() -> str:
    ops = """
SELECT p.request_id, a.target_database || '.' || a.target_schema || '.' || a.target_table AS k,
       count(*) AS n
FROM affected_rows a JOIN sc_plan p ON p.customer_email = a.e
WHERE p.decision = 'IN_PROGRESS' AND a.e IN (SELECT customer_email FROM erase)
GROUP BY ALL"""
    summary = """
SELECT request_id, '{' || string_agg('"' || k || '":' || CAST(n AS VARCHAR), ',' ORDER BY k) || '}' AS s
FROM ops GROUP BY request_id"""
    latest = """
SELECT customer_email, request_id FROM requests3
WHERE status IN ('IN_PROGRESS', 'COMPLETED')
  AND customer_email IN (SELECT customer_email FROM subj)
QUALIFY row_number() OVER (PARTITION BY customer_email ORDER BY requested_at DESC, request_id DESC) = 1"""
    events = """
SELECT 'ERASURE_REQUEST_SUBMITTED' AS event_type, customer_email,
       'Erasure request submitted with reason: WITHDRAWN_CONSENT' AS event_description,
       '{"request_id":"' || request_id || '","reason":"WITHDRAWN_CONSENT"}' AS event_data
FROM submitted WHERE outcome = 'ACCEPTED'
UNION ALL
SELECT 'ERASURE_REQUEST_COMPLETED', r.customer_email, 'Erasure request completed successfully',
       '{"request_id": "' || r.request_id || '", "deletion_summary": ' || coalesce(sm.s, '{}') || '}'
FROM requests3 r JOIN sc_plan p ON p.request_id = r.request_id AND p.decision = 'IN_PROGRESS'
LEFT JOIN summary sm ON sm.request_id = r.request_id
WHERE r.status = 'COMPLETED'
UNION ALL
SELECT 'THIRD_PARTY_COORDINATION_INITIATED', customer_email,
       'Third-party deletion coordination initiated',
       '{"request_id":"' || request_id || '","systems":["GOOGLE_ANALYTICS","MAILCHIMP","SALESFORCE","STRIPE","ZENDESK"]}'
FROM latest"""
    return _scenario_ctes(ops=ops, summary=summary, latest=latest, ev=events) + """
SELECT audit_id, event_type, event_timestamp, customer_email, event_description, event_data,
       sha256(audit_id || event_type || customer_email || CAST(event_timestamp AS VARCHAR)) AS audit_hash
FROM (SELECT 'AUDIT_' || substr(sha256(concat_ws('|', event_type, customer_email,
                                                 '2001-08-01 00:00:00', event_description, event_data)), 1, 32)
               AS audit_id,
             CAST(TIMESTAMP '2001-08-01 00:00:00' AS VARCHAR) AS event_timestamp, *
      FROM ev)"""


@register("workflow_audit", _workflow_audit_sql())
def workflow_audit(m):
    """The audit trail the scenario writes: submissions, completions and
    processor coordination, each row hashed."""
    from ..plans.scenario import full_scenario as run
    c = m["customers"]
    subj = c.where((F.col("consent_marketing") == F.lit(False))
                   & (F.col("consent_analytics") == F.lit(False))).select(
        F.col("email").alias("customer_email"))
    a = run(m, subj, AS_OF, SALT)["audit"]
    return a.select("audit_id", "event_type", "event_timestamp", "customer_email",
                    "event_description", "event_data", "audit_hash")


_TS_JSON = "strftime({c}, '%Y-%m-%dT%H:%M:%S.000Z')"


@register("subject_status_object", with_tables("px_customers", "px_erasure_requests", st=STATUS_SQL) + f"""
SELECT customer_email,
       '{{"customer_email":"' || customer_email || '","has_active_request":'
       || CASE WHEN has_active_request THEN 'true' ELSE 'false' END
       || coalesce(',"last_request_date":"' || {_TS_JSON.format(c='last_request_date')} || '"', '')
       || ',"deletion_completed":' || CASE WHEN deletion_completed THEN 'true' ELSE 'false' END
       || coalesce(',"data_retention_until":"' || CAST(data_retention_until AS VARCHAR) || '"', '')
       || CASE WHEN marketing IS NULL AND analytics IS NULL AND consent_given_date IS NULL THEN ''
               ELSE ',"consent_status":{{' || concat_ws(',',
                    CASE WHEN marketing IS NOT NULL THEN '"marketing":' || marketing END,
                    CASE WHEN analytics IS NOT NULL THEN '"analytics":' || analytics END,
                    CASE WHEN consent_given_date IS NOT NULL
                         THEN '"consent_given_date":"' || {_TS_JSON.format(c='consent_given_date')} || '"' END)
                    || '}}' END
       || '}}' AS compliance_status
FROM st""")
def subject_status_object(m):
    """The status function's OBJECT per customer, as JSON text (absent
    values omitted)."""
    st = Q.subject_status(m["customers"].select(F.col("email").alias("customer_email")),
                          m["erasure_requests"], m["customers"])
    return Q.subject_status_object(st)

"""DuckDB SQL for the derived compliance tables (the oracle side).

The same column rules as ``lethe.sources.derived``, written independently as
plain SQL over the driver views, so that every oracle query starts from the
raw tables.  ``with_tables(...)`` returns a ``WITH`` clause holding the named
derived tables and whatever they depend on.
"""

from __future__ import annotations

_CTES: dict[str, tuple[list[str], str]] = {
    "px_ckeys": ([], """
        SELECT c_custkey AS _k,
               'CUST_' || CAST(c_custkey AS VARCHAR) AS customer_id,
               'user' || CAST(c_custkey AS VARCHAR) || '@' || lower(c_mktsegment) || '.example.com' AS email,
               CAST(c_custkey AS VARCHAR) || ' Main Street' AS _street,
               'CITY_' || CAST(c_nationkey AS VARCHAR) AS _city,
               lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS _country,
               CASE WHEN c_custkey % 10 = 0 THEN NULL
                    ELSE CAST(DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS TIMESTAMP) END AS _consent_ts
        FROM customer"""),
    "px_customers": ([], """
        SELECT 'CUST_' || CAST(c_custkey AS VARCHAR) AS customer_id,
               'user' || CAST(c_custkey AS VARCHAR) || '@' || lower(c_mktsegment) || '.example.com' AS email,
               'First' || CAST(c_custkey % 97 AS VARCHAR) AS first_name,
               c_name AS last_name,
               '+1-555-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone_number,
               DATE '1960-01-01' + CAST((c_custkey * 37) % 18000 AS INTEGER) AS date_of_birth,
               CAST(c_custkey AS VARCHAR) || ' Main Street ' || CAST(c_nationkey AS VARCHAR) AS address_line1,
               CAST(NULL AS VARCHAR) AS address_line2,
               'CITY_' || CAST(c_nationkey AS VARCHAR) AS city,
               CAST(NULL AS VARCHAR) AS state_province,
               lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS postal_code,
               lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS country_code,
               c_custkey % 3 <> 0 AS consent_marketing,
               c_custkey % 4 <> 0 AS consent_analytics,
               CASE WHEN c_custkey % 10 = 0 THEN NULL
                    ELSE CAST(DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS TIMESTAMP) END AS consent_given_date,
               'CONSENT' AS lawful_basis,
               DATE '2001-08-01' + CAST(c_custkey % 120 - 60 AS INTEGER) AS data_retention_until,
               CAST(DATE '1994-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP) AS created_at,
               CAST(DATE '1994-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP) AS updated_at,
               c_custkey % 50 = 7 AS is_deleted,
               CAST(NULL AS TIMESTAMP) AS deleted_at,
               CAST(NULL AS VARCHAR) AS pii_classification
        FROM customer"""),
    "px_orders": (["px_ckeys"], """
        SELECT 'ORD_' || CAST(o_orderkey AS VARCHAR) AS order_id,
               k.customer_id,
               k.email AS customer_email,
               o_orderdate AS order_date,
               round(o_totalprice, 2) AS total_amount,
               (['CREDIT_CARD', 'PAYPAL', 'BANK_TRANSFER'])[o_orderkey % 3 + 1] AS payment_method,
               '{"street": "' || k._street || '", "city": "' || k._city || '", "country": "' || k._country || '"}' AS billing_address,
               o_orderstatus AS order_status,
               CAST(o_orderdate AS DATE) + CAST(365 + o_orderkey % 2000 AS INTEGER) AS legal_retention_until,
               o_orderkey % 4 <> 0 AS can_be_deleted,
               o_orderdate AS created_at
        FROM orders o JOIN px_ckeys k ON o.o_custkey = k._k"""),
    "px_user_activities": (["px_ckeys"], """
        SELECT 'EVT_' || CAST(event_id AS VARCHAR) AS event_id,
               k.customer_id,
               CASE WHEN event_id % 20 = 0 THEN NULL ELSE k.email END AS user_email,
               'SES_' || CAST(user_id AS VARCHAR) || '_' || CAST(day(ts) AS VARCHAR) AS session_id,
               event_type,
               ts AS event_timestamp,
               '/' || event_type AS page_url,
               'agent/' || CAST(event_id % 3 AS VARCHAR) AS user_agent,
               '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) AS ip_address,
               (['desktop', 'mobile', 'tablet'])[event_id % 3 + 1] AS device_type,
               (['chrome', 'firefox', 'safari', 'edge'])[event_id % 4 + 1] AS browser,
               k._country AS country_code,
               props AS event_properties,
               event_id % 6 = 0 AS is_pseudonymized,
               CASE WHEN event_id % 6 = 0 THEN 'PID_' || CAST(user_id AS VARCHAR) END AS pseudonym_id,
               event_id % 5 <> 0 AS consent_for_analytics,
               ts AS created_at
        FROM events e JOIN px_ckeys k ON e.user_id = k._k"""),
    "px_marketing_interactions": (["px_ckeys"], """
        SELECT 'INT_' || CAST(event_id AS VARCHAR) AS interaction_id,
               k.customer_id,
               k.email AS customer_email,
               'CMP_' || CAST(event_id % 10 AS VARCHAR) AS campaign_id,
               'Campaign ' || CAST(event_id % 10 AS VARCHAR) AS campaign_name,
               event_type AS interaction_type,
               ts AS interaction_timestamp,
               (['email', 'social', 'web'])[CAST(floor(event_id / 3) AS BIGINT) % 3 + 1] AS channel,
               round(value, 2) AS conversion_value
        FROM events e JOIN px_ckeys k ON e.user_id = k._k"""),
    "px_erasure_requests": (["px_ckeys"], """
        SELECT 'REQ_' || CAST(o_orderkey AS VARCHAR) AS request_id,
               k.customer_id,
               k.email AS customer_email,
               'FULL_ERASURE' AS request_type,
               (['WITHDRAWN_CONSENT', 'NO_LONGER_NECESSARY', 'UNLAWFUL_PROCESSING', 'OBJECTION',
                 'LEGAL_COMPLIANCE', 'JUST_BECAUSE'])[o_orderkey % 6 + 1] AS erasure_reason,
               'WEB_FORM' AS request_source,
               (['SUBMITTED', 'VALIDATED', 'IN_PROGRESS', 'COMPLETED', 'REJECTED'])[o_orderkey % 5 + 1] AS status,
               date_trunc('month', o_orderdate) AS requested_at,
               CASE WHEN o_orderkey % 5 = 3
                    THEN o_orderdate + to_days(CAST(31 + o_orderkey % 25 AS INTEGER)) END AS completed_at,
               CAST(date_trunc('month', o_orderdate) AS DATE) + 30 AS estimated_completion_date
        FROM orders o JOIN px_ckeys k ON o.o_custkey = k._k
        WHERE o_orderkey % 11 = 0"""),
    "px_retention_policies": ([], """
        SELECT 'POL_' || CAST(c_custkey AS VARCHAR) AS policy_id,
               'CUST_' || CAST(c_custkey AS VARCHAR) AS customer_id,
               DATE '2001-08-01' + CAST((c_custkey * 13) % 400 - 200 AS INTEGER) AS retention_end_date,
               c_custkey % 2 = 0 AS can_override_gdpr
        FROM customer WHERE c_custkey % 9 = 0"""),
    "px_audit_log": (["px_ckeys"], """
        SELECT 'AUD_' || CAST(event_id AS VARCHAR) AS audit_id,
               upper(event_type) AS event_type,
               ts AS event_timestamp,
               k.customer_id,
               CASE WHEN event_id % 20 = 0 THEN NULL ELSE k.email END AS customer_email,
               'agent_' || CAST(event_id % 7 AS VARCHAR) AS user_name
        FROM events e JOIN px_ckeys k ON e.user_id = k._k"""),
    "px_query_log": (["px_ckeys"], """
        SELECT 'QRY_' || CAST(event_id AS VARCHAR) AS query_id,
               'analyst_' || CAST(event_id % 9 AS VARCHAR) AS user_name,
               (['GDPR_ADMIN', 'DATA_SCIENTIST', 'SALES'])[event_id % 3 + 1] AS role_name,
               ts AS start_time,
               CASE event_id % 5 WHEN 0 THEN 'SELECT * FROM customers WHERE email = ' || chr(39) || k.email || chr(39)
                    WHEN 1 THEN 'SELECT count(*) FROM orders'
                    WHEN 2 THEN 'UPDATE Customer_Notes SET note = NULL WHERE id = ' || CAST(event_id AS VARCHAR)
                    WHEN 3 THEN 'select PERSONAL_DATA from profiles -- for ' || k.email
                    ELSE 'SELECT event_type FROM events' END AS query_text
        FROM events e JOIN px_ckeys k ON e.user_id = k._k"""),
    "px_support_tickets": (["px_ckeys"], """
        SELECT 'TICK_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS ticket_id,
               k.customer_id,
               k.email AS customer_email,
               role AS subject,
               text AS description
        FROM conversations cv JOIN px_ckeys k ON cv.conv_id % (SELECT count(*) FROM customer) = k._k"""),
    "px_order_items": ([], """
        SELECT 'OI_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS order_item_id,
               'ORD_' || CAST(l_orderkey AS VARCHAR) AS order_id
        FROM lineitem"""),
    "px_user_preferences": ([], """
        SELECT 'PREF_' || CAST(c_custkey AS VARCHAR) AS preference_id,
               'CUST_' || CAST(c_custkey AS VARCHAR) AS customer_id
        FROM customer"""),
    "px_customer_ml_features": ([], """
        SELECT 'FEAT_' || CAST(c_custkey AS VARCHAR) AS feature_id,
               'CUST_' || CAST(c_custkey AS VARCHAR) AS customer_id
        FROM customer"""),
    "px_classification": ([], """
        SELECT * FROM (VALUES
          ('CUSTOMER_DATA_DB', 'CORE', 'CUSTOMERS', 'email', 'EMAIL_ADDRESS'),
          ('CUSTOMER_DATA_DB', 'CORE', 'CUSTOMERS', 'phone_number', 'PHONE_NUMBER'),
          ('CUSTOMER_DATA_DB', 'CORE', 'CUSTOMERS', 'date_of_birth', 'DATE_OF_BIRTH'),
          ('CUSTOMER_DATA_DB', 'TRANSACTIONS', 'ORDERS', 'customer_email', 'EMAIL_ADDRESS'),
          ('ANALYTICS_DB', 'EVENTS', 'USER_ACTIVITIES', 'user_email', 'EMAIL_ADDRESS'),
          ('ANALYTICS_DB', 'EVENTS', 'USER_ACTIVITIES', 'ip_address', 'IP_ADDRESS'),
          ('CUSTOMER_DATA_DB', 'SUPPORT', 'SUPPORT_TICKETS', 'customer_email', 'EMAIL_ADDRESS'),
          ('ANALYTICS_DB', 'CAMPAIGNS', 'MARKETING_INTERACTIONS', 'customer_email', 'EMAIL_ADDRESS'))
          AS t(database_name, schema_name, table_name, column_name, pii_type)"""),
}


def with_tables(*names: str, **extra: str) -> str:
    """``WITH`` clause defining ``names`` (and their dependencies) in order,
    followed by the ``extra`` named statements."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({_CTES[n][1]})" for n in order]
    parts += [f"{n} AS ({sql})" for n, sql in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"

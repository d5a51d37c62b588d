"""Declared schemas of the compliance data model and a conforming writer.

A table is a DataFrame with a fixed ``StructType``.  ``conform`` is the
``INSERT`` side of a declared table: it orders and casts the given columns and
fills absent ones with the column default, so any producer (fixtures, derived
tables, workflow outputs) lands in one shape.  Semi-structured values are kept
as JSON strings; ``variant`` parsing happens where a query needs a field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, B, D, TS = (T.StringType(), T.LongType(), T.BooleanType(),
                  T.DateType(), T.TimestampType())
MONEY = T.DecimalType(10, 2)
SCORE = T.DecimalType(3, 2)
JSON = T.StringType()  # VARIANT / OBJECT / ARRAY, stored as JSON text


def _schema(*cols: tuple) -> T.StructType:
    return T.StructType([T.StructField(c[0], c[1], True) for c in cols])


# Column defaults of the declared tables.
NOW = "__now__"  # placeholder default: the statement time (as_of)
DEFAULTS: dict[str, dict[str, object]] = {
    "customers": {"consent_marketing": False, "consent_analytics": False,
                  "lawful_basis": "CONSENT", "is_deleted": False,
                  "created_at": NOW, "updated_at": NOW,
                  "pii_classification": '{"email": "EMAIL_ADDRESS", '
                                        '"phone_number": "PHONE_NUMBER", '
                                        '"address_line1": "POSTAL_ADDRESS"}'},
    "user_preferences": {"created_at": NOW, "updated_at": NOW},
    "orders": {"currency": "USD", "can_be_deleted": True, "created_at": NOW},
    "order_items": {},
    "support_tickets": {"priority": "MEDIUM", "status": "OPEN",
                        "created_at": NOW, "contains_pii": True},
    "user_activities": {"is_pseudonymized": False,
                        "consent_for_analytics": True, "created_at": NOW},
    "marketing_interactions": {"consent_basis": "MARKETING_CONSENT",
                               "created_at": NOW},
    "customer_ml_features": {"contains_sensitive_data": True,
                             "can_be_pseudonymized": True, "created_at": NOW},
    "erasure_requests": {"request_type": "FULL_ERASURE",
                         "request_source": "WEB_FORM", "status": "SUBMITTED",
                         "requested_at": NOW},
    "data_discovery_results": {"discovered_at": NOW},
    "erasure_operations": {"executed_at": NOW, "operation_status": "PENDING"},
    "gdpr_audit_log": {"event_timestamp": NOW, "retention_applied": False},
    "third_party_notifications": {"status": "PENDING", "created_at": NOW},
    "retention_policies": {"can_override_gdpr": False, "created_at": NOW},
    "gdpr_config": {"last_updated": NOW},
    "data_classification": {"consent_required": True, "can_be_deleted": True,
                            "created_at": NOW},
}

SCHEMAS: dict[str, T.StructType] = {
    "customers": _schema(
        ("customer_id", S), ("email", S), ("first_name", S), ("last_name", S),
        ("phone_number", S), ("date_of_birth", D), ("address_line1", S),
        ("address_line2", S), ("city", S), ("state_province", S),
        ("postal_code", S), ("country_code", S), ("consent_marketing", B),
        ("consent_analytics", B), ("consent_given_date", TS),
        ("lawful_basis", S), ("data_retention_until", D), ("created_at", TS),
        ("updated_at", TS), ("is_deleted", B), ("deleted_at", TS),
        ("pii_classification", JSON)),
    "user_preferences": _schema(
        ("preference_id", S), ("customer_id", S), ("preference_key", S),
        ("preference_value", JSON), ("created_at", TS), ("updated_at", TS)),
    "orders": _schema(
        ("order_id", S), ("customer_id", S), ("customer_email", S),
        ("order_date", TS), ("total_amount", MONEY), ("currency", S),
        ("payment_method", S), ("billing_address", JSON),
        ("shipping_address", JSON), ("order_status", S),
        ("legal_retention_until", D), ("can_be_deleted", B),
        ("created_at", TS)),
    "order_items": _schema(
        ("order_item_id", S), ("order_id", S), ("product_id", S),
        ("product_name", S), ("quantity", L), ("unit_price", MONEY),
        ("total_price", MONEY)),
    "support_tickets": _schema(
        ("ticket_id", S), ("customer_id", S), ("customer_email", S),
        ("subject", S), ("description", S), ("priority", S), ("status", S),
        ("assigned_agent", S), ("created_at", TS), ("resolved_at", TS),
        ("contains_pii", B)),
    "user_activities": _schema(
        ("event_id", S), ("customer_id", S), ("user_email", S),
        ("session_id", S), ("event_type", S), ("event_timestamp", TS),
        ("page_url", S), ("user_agent", S), ("ip_address", S),
        ("device_type", S), ("browser", S), ("country_code", S),
        ("event_properties", JSON), ("is_pseudonymized", B),
        ("pseudonym_id", S), ("consent_for_analytics", B), ("created_at", TS)),
    "marketing_interactions": _schema(
        ("interaction_id", S), ("customer_id", S), ("customer_email", S),
        ("campaign_id", S), ("campaign_name", S), ("interaction_type", S),
        ("interaction_timestamp", TS), ("channel", S), ("content_id", S),
        ("conversion_value", MONEY), ("consent_basis", S),
        ("consent_timestamp", TS), ("created_at", TS)),
    "customer_ml_features": _schema(
        ("feature_id", S), ("customer_id", S), ("feature_set_name", S),
        ("features", JSON), ("model_version", S), ("computed_at", TS),
        ("contains_sensitive_data", B), ("can_be_pseudonymized", B),
        ("created_at", TS)),
    "erasure_requests": _schema(
        ("request_id", S), ("customer_id", S), ("customer_email", S),
        ("request_type", S), ("erasure_reason", S), ("request_source", S),
        ("status", S), ("requested_at", TS), ("validated_at", TS),
        ("started_at", TS), ("completed_at", TS),
        ("legal_basis_override", S), ("retention_exceptions", JSON),
        ("estimated_completion_date", D), ("actual_completion_date", D),
        ("systems_affected", JSON), ("data_discovered", JSON),
        ("deletion_summary", JSON), ("verification_hash", S),
        ("verification_timestamp", TS), ("confirmation_sent_at", TS),
        ("completion_notification_sent_at", TS)),
    "data_discovery_results": _schema(
        ("discovery_id", S), ("request_id", S), ("customer_email", S),
        ("database_name", S), ("schema_name", S), ("table_name", S),
        ("column_name", S), ("data_type", S), ("pii_classification", S),
        ("records_found", L), ("sensitive_data_detected", B),
        ("can_be_deleted", B), ("deletion_restrictions", S),
        ("retention_requirement", S), ("legal_basis", S),
        ("discovered_at", TS)),
    "erasure_operations": _schema(
        ("operation_id", S), ("request_id", S), ("operation_type", S),
        ("target_database", S), ("target_schema", S), ("target_table", S),
        ("operation_sql", S), ("executed_at", TS), ("executed_by", S),
        ("operation_status", S), ("error_message", S),
        ("records_affected", L), ("before_hash", S), ("after_hash", S),
        ("verification_query", S)),
    "gdpr_audit_log": _schema(
        ("audit_id", S), ("event_type", S), ("event_timestamp", TS),
        ("customer_id", S), ("customer_email", S), ("user_name", S),
        ("role_name", S), ("session_id", S), ("client_ip", S),
        ("event_description", S), ("event_data", JSON), ("request_id", S),
        ("operation_id", S), ("affected_systems", JSON),
        ("data_categories", JSON), ("legal_basis", S), ("consent_status", S),
        ("retention_applied", B), ("query_id", S), ("warehouse_name", S),
        ("audit_hash", S)),
    "third_party_notifications": _schema(
        ("notification_id", S), ("request_id", S), ("customer_email", S),
        ("third_party_name", S), ("third_party_type", S),
        ("notification_type", S), ("sent_at", TS), ("method", S),
        ("api_endpoint", S), ("request_payload", JSON),
        ("response_payload", JSON), ("status", S), ("acknowledged_at", TS),
        ("completed_at", TS), ("confirmation_token", S),
        ("verification_data", JSON), ("created_at", TS)),
    "retention_policies": _schema(
        ("policy_id", S), ("customer_id", S), ("data_category", S),
        ("retention_reason", S), ("retention_period_months", L),
        ("retention_start_date", D), ("retention_end_date", D),
        ("jurisdiction", S), ("legal_reference", S),
        ("can_override_gdpr", B), ("override_justification", S),
        ("created_at", TS), ("created_by", S)),
    "gdpr_config": _schema(
        ("config_key", S), ("config_value", JSON), ("description", S),
        ("last_updated", TS), ("updated_by", S)),
    "data_classification": _schema(
        ("classification_id", S), ("database_name", S), ("schema_name", S),
        ("table_name", S), ("column_name", S), ("pii_type", S),
        ("sensitivity_level", S), ("data_category", S),
        ("processing_purpose", S), ("lawful_basis", S),
        ("consent_required", B), ("default_retention_period_months", L),
        ("can_be_deleted", B), ("deletion_dependencies", JSON),
        ("detection_method", S), ("confidence_score", SCORE),
        ("last_reviewed", TS), ("reviewed_by", S), ("created_at", TS)),
}

# Where each declared table lives (database, schema).
LOCATION: dict[str, tuple[str, str]] = {
    "customers": ("CUSTOMER_DATA_DB", "CORE"),
    "user_preferences": ("CUSTOMER_DATA_DB", "PREFERENCES"),
    "orders": ("CUSTOMER_DATA_DB", "TRANSACTIONS"),
    "order_items": ("CUSTOMER_DATA_DB", "TRANSACTIONS"),
    "support_tickets": ("CUSTOMER_DATA_DB", "SUPPORT"),
    "user_activities": ("ANALYTICS_DB", "EVENTS"),
    "marketing_interactions": ("ANALYTICS_DB", "CAMPAIGNS"),
    "customer_ml_features": ("ANALYTICS_DB", "ML_MODELS"),
    "erasure_requests": ("COMPLIANCE_DB", "REQUESTS"),
    "data_discovery_results": ("COMPLIANCE_DB", "REQUESTS"),
    "erasure_operations": ("COMPLIANCE_DB", "REQUESTS"),
    "gdpr_audit_log": ("COMPLIANCE_DB", "AUDIT"),
    "third_party_notifications": ("COMPLIANCE_DB", "NOTIFICATIONS"),
    "retention_policies": ("COMPLIANCE_DB", "LEGAL"),
    "gdpr_config": ("REFERENCE_DB", "CONFIG"),
    "data_classification": ("REFERENCE_DB", "METADATA"),
}


def _default(value: object, dtype: T.DataType, as_of_ts: Column | None) -> Column:
    if value == NOW:
        return (as_of_ts if as_of_ts is not None else F.current_timestamp()).cast(dtype)
    return F.lit(value).cast(dtype)


def conform(df: DataFrame, table: str, as_of_ts: Column | None = None) -> DataFrame:
    """Project ``df`` onto the declared schema of ``table``.

    Present columns are cast; absent columns get the column default (as an
    ``INSERT`` that omits them would) or NULL.  Extra columns are dropped.
    """
    schema = SCHEMAS[table]
    defaults = DEFAULTS.get(table, {})
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in have:
            c = F.col(f.name).cast(f.dataType)
        elif f.name in defaults:
            c = _default(defaults[f.name], f.dataType, as_of_ts)
        else:
            c = F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def empty(spark, table: str):
    return spark.createDataFrame([], SCHEMAS[table])

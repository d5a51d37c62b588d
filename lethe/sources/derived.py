"""The compliance data model, derived from the driver tables.

The driver ships TPC-H-style tables without personal-data columns, so the
compliance tables (customers with e-mails and consents, orders with a
denormalized e-mail, activities, requests, holds, audit log, tickets, ...)
are derived from them with deterministic column rules.  Each derivation is a
narrow projection of one driver table, joined at most to the customer
dimension on its key, so its cost grows linearly with the data and Catalyst
prunes every column a query does not use.

``as_of`` replaces ``CURRENT_DATE`` everywhere: results are reproducible and
can be compared with an independent SQL engine.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import LOCATION, conform
from .tables import TableSet

# The reference dates of the derived data.
AS_OF = dt.date(2001, 8, 1)          # orders, customers, requests, holds
EVENTS_AS_OF = dt.date(2024, 1, 31)  # activity and audit streams

# The six GDPR Article 17 grounds accepted at submission.
VALID_REASONS = ["WITHDRAWN_CONSENT", "NO_LONGER_NECESSARY",
                 "UNLAWFUL_PROCESSING", "OBJECTION", "LEGAL_COMPLIANCE",
                 "CHILD_CONSENT"]
# Request states, in lifecycle order.
REQUEST_STATES = ["SUBMITTED", "VALIDATED", "IN_PROGRESS", "COMPLETED",
                  "REJECTED"]
# Derivation choices: reasons drawn by key (the sixth is deliberately invalid).
DERIVED_REASONS = VALID_REASONS[:5] + ["JUST_BECAUSE"]


def _s(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


def _pick(values: list[str], idx: Column) -> Column:
    """values[idx] for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _days(base: dt.date, n: Column) -> Column:
    return F.date_add(F.lit(base), n.cast("int"))


def _as_ts(d: Column) -> Column:
    return d.cast("timestamp")


def customers(t: TableSet) -> DataFrame:
    c = t["customer"]
    k = F.col("c_custkey")
    return conform(c.select(
        F.concat(F.lit("CUST_"), _s(k)).alias("customer_id"),
        F.concat(F.lit("user"), _s(k), F.lit("@"), F.lower("c_mktsegment"),
                 F.lit(".example.com")).alias("email"),
        F.concat(F.lit("First"), _s(k % 97)).alias("first_name"),
        F.col("c_name").alias("last_name"),
        F.concat(F.lit("+1-555-"), F.lpad(_s(k), 7, "0")).alias("phone_number"),
        _days(dt.date(1960, 1, 1), (k * 37) % 18000).alias("date_of_birth"),
        F.concat(_s(k), F.lit(" Main Street "), _s("c_nationkey")).alias("address_line1"),
        F.concat(F.lit("CITY_"), _s("c_nationkey")).alias("city"),
        F.lpad(_s(k % 100000), 5, "0").alias("postal_code"),
        F.lpad(_s("c_nationkey"), 2, "0").alias("country_code"),
        (k % 3 != 0).alias("consent_marketing"),
        (k % 4 != 0).alias("consent_analytics"),
        F.when(k % 10 == 0, F.lit(None).cast("timestamp"))
         .otherwise(_as_ts(_days(dt.date(1995, 1, 1), k % 2000))).alias("consent_given_date"),
        F.lit("CONSENT").alias("lawful_basis"),
        _days(AS_OF, k % 120 - 60).alias("data_retention_until"),
        _as_ts(_days(dt.date(1994, 1, 1), k % 365)).alias("created_at"),
        _as_ts(_days(dt.date(1994, 1, 1), k % 365)).alias("updated_at"),
        (k % 50 == 7).alias("is_deleted"),
    ), "customers")


def _customer_keys(t: TableSet) -> DataFrame:
    """Key → (customer_id, email, consent date, country): the subject dimension."""
    c = t["customer"]
    k = F.col("c_custkey")
    return c.select(
        k.alias("_k"),
        F.concat(F.lit("CUST_"), _s(k)).alias("customer_id"),
        F.concat(F.lit("user"), _s(k), F.lit("@"), F.lower("c_mktsegment"),
                 F.lit(".example.com")).alias("email"),
        F.concat(_s(k), F.lit(" Main Street")).alias("_street"),
        F.concat(F.lit("CITY_"), _s("c_nationkey")).alias("_city"),
        F.lpad(_s("c_nationkey"), 2, "0").alias("_country"),
        F.when(k % 10 == 0, F.lit(None).cast("timestamp"))
         .otherwise(_as_ts(_days(dt.date(1995, 1, 1), k % 2000))).alias("_consent_ts"),
    )


def _address_json(street: Column, city: Column, country: Column) -> Column:
    return F.concat(F.lit('{"street": "'), street, F.lit('", "city": "'), city,
                    F.lit('", "country": "'), country, F.lit('"}'))


def orders(t: TableSet) -> DataFrame:
    o = t["orders"]
    ok = F.col("o_orderkey")
    j = o.join(_customer_keys(t), o.o_custkey == F.col("_k"), "inner")
    addr = _address_json(F.col("_street"), F.col("_city"), F.col("_country"))
    return conform(j.select(
        F.concat(F.lit("ORD_"), _s(ok)).alias("order_id"),
        "customer_id",
        F.col("email").alias("customer_email"),
        F.col("o_orderdate").alias("order_date"),
        F.round("o_totalprice", 2).alias("total_amount"),
        _pick(["CREDIT_CARD", "PAYPAL", "BANK_TRANSFER"], ok % 3).alias("payment_method"),
        addr.alias("billing_address"),
        addr.alias("shipping_address"),
        F.col("o_orderstatus").alias("order_status"),
        F.date_add(F.to_date("o_orderdate"), (F.lit(365) + ok % 2000).cast("int"))
         .alias("legal_retention_until"),
        (ok % 4 != 0).alias("can_be_deleted"),
        F.col("o_orderdate").alias("created_at"),
    ), "orders")


def order_items(t: TableSet) -> DataFrame:
    li = t["lineitem"]
    p = t["part"].select("p_partkey", "p_name")
    j = li.join(p, li.l_partkey == p.p_partkey, "left")
    return conform(j.select(
        F.concat(F.lit("OI_"), _s("l_orderkey"), F.lit("_"), _s("l_linenumber")).alias("order_item_id"),
        F.concat(F.lit("ORD_"), _s("l_orderkey")).alias("order_id"),
        F.concat(F.lit("PRD_"), _s("l_partkey")).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("unit_price"),
        F.round("l_extendedprice", 2).alias("total_price"),
    ), "order_items")


def user_activities(t: TableSet) -> DataFrame:
    e = t["events"]
    eid = F.col("event_id")
    uid = F.col("user_id")
    j = e.join(_customer_keys(t), uid == F.col("_k"), "inner")
    pseudo = eid % 6 == 0
    return conform(j.select(
        F.concat(F.lit("EVT_"), _s(eid)).alias("event_id"),
        "customer_id",
        F.when(eid % 20 == 0, F.lit(None).cast("string")).otherwise(F.col("email")).alias("user_email"),
        F.concat(F.lit("SES_"), _s(uid), F.lit("_"), _s(F.dayofmonth("ts"))).alias("session_id"),
        "event_type",
        F.col("ts").alias("event_timestamp"),
        F.concat(F.lit("/"), F.col("event_type")).alias("page_url"),
        F.concat(F.lit("agent/"), _s(eid % 3)).alias("user_agent"),
        F.concat(F.lit("10.0."), _s(uid % 256), F.lit("."), _s(eid % 256)).alias("ip_address"),
        _pick(["desktop", "mobile", "tablet"], eid % 3).alias("device_type"),
        _pick(["chrome", "firefox", "safari", "edge"], eid % 4).alias("browser"),
        F.col("_country").alias("country_code"),
        F.col("props").alias("event_properties"),
        pseudo.alias("is_pseudonymized"),
        F.when(pseudo, F.concat(F.lit("PID_"), _s(uid))).alias("pseudonym_id"),
        (eid % 5 != 0).alias("consent_for_analytics"),
        F.col("ts").alias("created_at"),
    ), "user_activities")


def marketing_interactions(t: TableSet) -> DataFrame:
    e = t["events"]
    eid = F.col("event_id")
    j = e.join(_customer_keys(t), F.col("user_id") == F.col("_k"), "inner")
    return conform(j.select(
        F.concat(F.lit("INT_"), _s(eid)).alias("interaction_id"),
        "customer_id",
        F.col("email").alias("customer_email"),
        F.concat(F.lit("CMP_"), _s(eid % 10)).alias("campaign_id"),
        F.concat(F.lit("Campaign "), _s(eid % 10)).alias("campaign_name"),
        F.col("event_type").alias("interaction_type"),
        F.col("ts").alias("interaction_timestamp"),
        _pick(["email", "social", "web"], F.floor(eid / 3) % 3).alias("channel"),
        F.concat(F.lit("CNT_"), _s(eid % 100)).alias("content_id"),
        F.round("value", 2).alias("conversion_value"),
        F.col("_consent_ts").alias("consent_timestamp"),
        F.col("ts").alias("created_at"),
    ), "marketing_interactions")


def customer_ml_features(t: TableSet) -> DataFrame:
    c = t["customer"]
    k = F.col("c_custkey")
    return conform(c.select(
        F.concat(F.lit("FEAT_"), _s(k)).alias("feature_id"),
        F.concat(F.lit("CUST_"), _s(k)).alias("customer_id"),
        F.lit("customer_value").alias("feature_set_name"),
        F.concat(F.lit('{"balance": '), _s(F.round("c_acctbal").cast("long")),
                 F.lit(', "segment": "'), F.col("c_mktsegment"), F.lit('"}')).alias("features"),
        F.lit("v1").alias("model_version"),
        _as_ts(F.lit(dt.date(2001, 7, 1))).alias("computed_at"),
    ), "customer_ml_features")


def user_preferences(t: TableSet) -> DataFrame:
    c = t["customer"]
    k = F.col("c_custkey")
    return conform(c.select(
        F.concat(F.lit("PREF_"), _s(k)).alias("preference_id"),
        F.concat(F.lit("CUST_"), _s(k)).alias("customer_id"),
        F.lit("segment_newsletter").alias("preference_key"),
        F.concat(F.lit('{"segment": "'), F.col("c_mktsegment"), F.lit('"}')).alias("preference_value"),
    ), "user_preferences")


def erasure_requests(t: TableSet) -> DataFrame:
    o = t["orders"].where(F.col("o_orderkey") % 11 == 0)
    ok = F.col("o_orderkey")
    j = o.join(_customer_keys(t), o.o_custkey == F.col("_k"), "inner")
    status = _pick(REQUEST_STATES, ok % 5)
    requested = F.date_trunc("month", "o_orderdate")
    completed = F.when(status == "COMPLETED",
                       F.timestamp_add("DAY", (F.lit(31) + ok % 25).cast("int"),
                                       F.col("o_orderdate")))
    return conform(j.select(
        F.concat(F.lit("REQ_"), _s(ok)).alias("request_id"),
        "customer_id",
        F.col("email").alias("customer_email"),
        F.lit("FULL_ERASURE").alias("request_type"),
        _pick(DERIVED_REASONS, ok % 6).alias("erasure_reason"),
        F.lit("WEB_FORM").alias("request_source"),
        status.alias("status"),
        requested.alias("requested_at"),
        completed.alias("completed_at"),
        F.date_add(F.to_date(requested), 30).alias("estimated_completion_date"),
        F.to_date(completed).alias("actual_completion_date"),
    ), "erasure_requests")


def retention_policies(t: TableSet) -> DataFrame:
    c = t["customer"].where(F.col("c_custkey") % 9 == 0)
    k = F.col("c_custkey")
    return conform(c.select(
        F.concat(F.lit("POL_"), _s(k)).alias("policy_id"),
        F.concat(F.lit("CUST_"), _s(k)).alias("customer_id"),
        F.lit("FINANCIAL_TRANSACTIONS").alias("data_category"),
        _pick(["TAX_COMPLIANCE", "LEGAL_INVESTIGATION"], k % 2).alias("retention_reason"),
        F.lit(84).cast("long").alias("retention_period_months"),
        F.lit(dt.date(1994, 8, 1)).alias("retention_start_date"),
        _days(AS_OF, (k * 13) % 400 - 200).alias("retention_end_date"),
        F.lit("EU").alias("jurisdiction"),
        F.lit("Article 17(3)").alias("legal_reference"),
        (k % 2 == 0).alias("can_override_gdpr"),
    ), "retention_policies")


def gdpr_audit_log(t: TableSet) -> DataFrame:
    e = t["events"]
    eid = F.col("event_id")
    j = e.join(_customer_keys(t), F.col("user_id") == F.col("_k"), "inner")
    return conform(j.select(
        F.concat(F.lit("AUD_"), _s(eid)).alias("audit_id"),
        F.upper("event_type").alias("event_type"),
        F.col("ts").alias("event_timestamp"),
        "customer_id",
        F.when(eid % 20 == 0, F.lit(None).cast("string")).otherwise(F.col("email")).alias("customer_email"),
        F.concat(F.lit("agent_"), _s(eid % 7)).alias("user_name"),
        F.lit("GDPR_ADMIN").alias("role_name"),
        F.concat(F.lit("event "), F.col("event_type")).alias("event_description"),
        F.col("props").alias("event_data"),
    ), "gdpr_audit_log")


def support_tickets(t: TableSet) -> DataFrame:
    cv = t["conversations"]
    cid = F.col("conv_id")
    # conversations are dealt over all customers, so tickets a customer do not grow with the data
    owners = t["customer"].agg(F.count(F.lit(1)).alias("n")).scalar()
    owned = cv.withColumn("_owner", cid % owners)
    j = owned.join(_customer_keys(t), F.col("_owner") == F.col("_k"), "inner")
    return conform(j.select(
        F.concat(F.lit("TICK_"), _s(cid), F.lit("_"), _s("turn")).alias("ticket_id"),
        "customer_id",
        F.col("email").alias("customer_email"),
        F.col("role").alias("subject"),
        F.col("text").alias("description"),
        _pick(["LOW", "MEDIUM", "HIGH"], F.col("turn") % 3).alias("priority"),
        _pick(["OPEN", "CLOSED"], cid % 2).alias("status"),
        F.concat(F.lit("agent_"), _s(cid % 7)).alias("assigned_agent"),
        _as_ts(_days(dt.date(2001, 1, 1), cid % 200)).alias("created_at"),
    ), "support_tickets")


def query_log(t: TableSet) -> DataFrame:
    """A log of statements that users ran: who, as what, when and the text."""
    e = t["events"]
    eid = F.col("event_id")
    j = e.join(_customer_keys(t), F.col("user_id") == F.col("_k"), "inner")
    text = (F.when(eid % 5 == 0, F.concat(F.lit("SELECT * FROM customers WHERE email = '"), F.col("email"), F.lit("'")))
             .when(eid % 5 == 1, F.lit("SELECT count(*) FROM orders"))
             .when(eid % 5 == 2, F.concat(F.lit("UPDATE Customer_Notes SET note = NULL WHERE id = "), _s(eid)))
             .when(eid % 5 == 3, F.concat(F.lit("select PERSONAL_DATA from profiles -- for "), F.col("email")))
             .otherwise(F.lit("SELECT event_type FROM events")))
    return j.select(F.concat(F.lit("QRY_"), _s(eid)).alias("query_id"),
                    F.concat(F.lit("analyst_"), _s(eid % 9)).alias("user_name"),
                    _pick(["GDPR_ADMIN", "DATA_SCIENTIST", "SALES"], eid % 3).alias("role_name"),
                    F.col("ts").alias("start_time"), text.alias("query_text"))


# The configuration rows of the reference data model.
CONFIG_ROWS = [
    ("MAX_RESPONSE_TIME_DAYS", "30", "Days within which a request must be answered"),
    ("AUTO_APPROVE_SIMPLE_REQUESTS", "true", "Approve plain requests without review"),
    ("REQUIRE_IDENTITY_VERIFICATION", "true", "Check identity before a request is taken"),
    ("DEFAULT_RETENTION_YEARS", "7", "Years data is kept unless a policy says otherwise"),
    ("ENABLE_PSEUDONYMIZATION", "true", "Keep analytics rows under pseudonyms"),
    ("NOTIFICATION_EMAIL", '"privacy-office@lethe.example"', "Where notices go"),
    ("THIRD_PARTY_COORDINATION_ENABLED", "true", "Notify processors of erasures"),
]


def gdpr_config(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(CONFIG_ROWS, "config_key string, config_value string, description string")
    return conform(df, "gdpr_config", F.lit(dt.datetime(2001, 8, 1)))


# Curated column labels of the derived tables (database, schema, table,
# column, pii_type, sensitivity).  Metadata, a handful of rows.
CLASSIFICATION_ROWS = [
    ("CLASS_001", "CUSTOMER_DATA_DB", "CORE", "CUSTOMERS", "email", "EMAIL_ADDRESS", "HIGH"),
    ("CLASS_002", "CUSTOMER_DATA_DB", "CORE", "CUSTOMERS", "phone_number", "PHONE_NUMBER", "HIGH"),
    ("CLASS_003", "CUSTOMER_DATA_DB", "CORE", "CUSTOMERS", "date_of_birth", "DATE_OF_BIRTH", "CRITICAL"),
    ("CLASS_004", "CUSTOMER_DATA_DB", "TRANSACTIONS", "ORDERS", "customer_email", "EMAIL_ADDRESS", "HIGH"),
    ("CLASS_005", "ANALYTICS_DB", "EVENTS", "USER_ACTIVITIES", "user_email", "EMAIL_ADDRESS", "MEDIUM"),
    ("CLASS_006", "ANALYTICS_DB", "EVENTS", "USER_ACTIVITIES", "ip_address", "IP_ADDRESS", "MEDIUM"),
    ("CLASS_007", "CUSTOMER_DATA_DB", "SUPPORT", "SUPPORT_TICKETS", "customer_email", "EMAIL_ADDRESS", "HIGH"),
    ("CLASS_008", "ANALYTICS_DB", "CAMPAIGNS", "MARKETING_INTERACTIONS", "customer_email", "EMAIL_ADDRESS", "MEDIUM"),
]


def data_classification(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(
        CLASSIFICATION_ROWS,
        "classification_id string, database_name string, schema_name string, "
        "table_name string, column_name string, pii_type string, sensitivity_level string")
    return conform(df, "data_classification", F.lit(dt.datetime(2001, 8, 1)))


DERIVED = {
    "customers": customers,
    "user_preferences": user_preferences,
    "orders": orders,
    "order_items": order_items,
    "support_tickets": support_tickets,
    "user_activities": user_activities,
    "marketing_interactions": marketing_interactions,
    "customer_ml_features": customer_ml_features,
    "erasure_requests": erasure_requests,
    "retention_policies": retention_policies,
    "gdpr_audit_log": gdpr_audit_log,
}


class ComplianceModel:
    """The named tables of the data model over one folder of driver data.

    ``model["orders"]`` is the lazily derived DataFrame; ``model.location``
    gives the (database, schema) of a table, the three-level name of the
    reference's catalog.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.tables = TableSet(spark, sf_dir)
        self._dfs: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._dfs:
            if name == "gdpr_config":
                self._dfs[name] = gdpr_config(self.spark)
            elif name == "query_log":
                self._dfs[name] = query_log(self.tables)
            elif name == "data_classification":
                self._dfs[name] = data_classification(self.spark)
            else:
                self._dfs[name] = DERIVED[name](self.tables)
        return self._dfs[name]

    def names(self) -> list[str]:
        return list(DERIVED)

    @staticmethod
    def location(name: str) -> tuple[str, str]:
        return LOCATION[name]

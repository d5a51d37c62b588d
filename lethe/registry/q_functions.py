"""Registered queries: masking policies, scalar functions, classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import masking as M
from ..sources.derived import AS_OF
from .core import canon_sql, register
from .oracle_base import with_tables

KEEP2 = "regexp_replace({v}, '^(.{{2}}).*(@.*)$', '\\1****\\2')"
KEEP1 = "regexp_replace({v}, '^(.).*(@.*)$', '\\1****\\2')"


@register("mask_email", with_tables("px_user_activities") + f"""
SELECT event_id,
       user_email AS email_customer_service,
       {KEEP2.format(v='user_email')} AS email_analytics,
       {KEEP1.format(v='user_email')} AS email_marketing,
       '*****@*****.***' AS email_public
FROM px_user_activities""")
def mask_email(m):
    """E-mail mask for four roles (NULL e-mails included)."""
    a = m["user_activities"]
    return a.select("event_id", *[M.mask_email("user_email", r).alias(f"email_{n}") for n, r in (
        ("customer_service", "CUSTOMER_SERVICE"), ("analytics", "DATA_SCIENTIST"),
        ("marketing", "MARKETING_TEAM"), ("public", "PUBLIC"))])


@register("mask_email_simple", with_tables("px_customers") + """
SELECT customer_id, email AS email_dpo, regexp_replace(email, '.{1,}@', '*****@') AS email_other
FROM px_customers""")
def mask_email_simple(m):
    """Documented simple e-mail mask: clear for two roles, local part starred otherwise."""
    c = m["customers"]
    return c.select("customer_id",
                    M.mask_email_simple("email", "DATA_PROTECTION_OFFICER").alias("email_dpo"),
                    M.mask_email_simple("email", "SALES").alias("email_other"))


PHONE_SQL = """CASE WHEN {v} IS NULL THEN NULL
            WHEN length({v}) >= 10 THEN left({v}, 3) || '-***-' || right({v}, 4)
            ELSE '***-***-****' END"""
NAME_SQL = """CASE WHEN {v} IS NULL THEN NULL
            WHEN length({v}) > 1 THEN left({v}, 1) || repeat('*', length({v}) - 1)
            ELSE '*' END"""
ADDR_SQL = "regexp_replace({v}, '\\d+', '***', 'g')"
DOB_SQL = "make_date(year({v}), 1, 1)"


@register("mask_phone", with_tables("px_customers") + f"""
SELECT customer_id, phone_number AS phone_support,
       {PHONE_SQL.format(v='phone_number')} AS phone_other,
       {PHONE_SQL.format(v='postal_code')} AS short_value_other
FROM px_customers""")
def mask_phone(m):
    """Phone mask; the 5-character postal code exercises the short branch."""
    c = m["customers"]
    return c.select("customer_id",
                    M.mask_phone("phone_number", "CUSTOMER_SERVICE").alias("phone_support"),
                    M.mask_phone("phone_number", "MARKETING_TEAM").alias("phone_other"),
                    M.mask_phone("postal_code", "SALES").alias("short_value_other"))


@register("mask_address", with_tables("px_customers") + f"""
SELECT customer_id, address_line1 AS address_shipping,
       {ADDR_SQL.format(v='address_line1')} AS address_other,
       {ADDR_SQL.format(v='address_line2')} AS address2_other
FROM px_customers""")
def mask_address(m):
    """Address mask: digit runs starred except for shipping and support roles."""
    c = m["customers"]
    return c.select("customer_id",
                    M.mask_address("address_line1", "SHIPPING").alias("address_shipping"),
                    M.mask_address("address_line1", "ANALYTICS_TEAM").alias("address_other"),
                    M.mask_address("address_line2", "ANALYTICS_TEAM").alias("address2_other"))


@register("mask_name", with_tables("px_customers") + f"""
SELECT customer_id, first_name AS first_support,
       {NAME_SQL.format(v='first_name')} AS first_other,
       {NAME_SQL.format(v='last_name')} AS last_other,
       {NAME_SQL.format(v="left(country_code, 1)")} AS single_letter_other
FROM px_customers""")
def mask_name(m):
    """Name mask: first letter kept, the rest starred; a single letter becomes '*'."""
    c = m["customers"]
    return c.select("customer_id",
                    M.mask_name("first_name", "GDPR_ADMIN").alias("first_support"),
                    M.mask_name("first_name", "SALES").alias("first_other"),
                    M.mask_name("last_name", "SALES").alias("last_other"),
                    M.mask_name(F.left("country_code", F.lit(1)), "SALES").alias("single_letter_other"))


@register("mask_dob", canon_sql(with_tables("px_customers") + f"""
SELECT customer_id, date_of_birth AS dob_support, {DOB_SQL.format(v='date_of_birth')} AS dob_other
FROM px_customers""", ["dob_support", "dob_other"]))
def mask_dob(m):
    """Date-of-birth mask: only the year is kept."""
    c = m["customers"]
    return c.select("customer_id",
                    M.mask_dob("date_of_birth", "CUSTOMER_SERVICE").alias("dob_support"),
                    M.mask_dob("date_of_birth", "MARKETING_TEAM").alias("dob_other"))


@register("masked_customers", canon_sql(with_tables("px_customers") + f"""
SELECT customer_id, {KEEP2.format(v='email')} AS email,
       {NAME_SQL.format(v='first_name')} AS first_name,
       {NAME_SQL.format(v='last_name')} AS last_name,
       {PHONE_SQL.format(v='phone_number')} AS phone_number,
       {DOB_SQL.format(v='date_of_birth')} AS date_of_birth,
       {ADDR_SQL.format(v='address_line1')} AS address_line1,
       {ADDR_SQL.format(v='address_line2')} AS address_line2,
       city, country_code
FROM px_customers""", ["date_of_birth"]))
def masked_customers(m):
    """Customer table as an analyst sees it (all seven column masks)."""
    c = m["customers"].select("customer_id", "email", "first_name", "last_name",
                              "phone_number", "date_of_birth", "address_line1",
                              "address_line2", "city", "country_code")
    return M.masked_customers(c, "ANALYTICS_TEAM")


@register("masked_other_tables", with_tables("px_orders", "px_support_tickets",
                                             "px_user_activities", "px_marketing_interactions") + f"""
SELECT 'orders' AS table_name, order_id AS row_id, {KEEP1.format(v='customer_email')} AS email FROM px_orders
UNION ALL SELECT 'support_tickets', ticket_id, {KEEP1.format(v='customer_email')} FROM px_support_tickets
UNION ALL SELECT 'user_activities', event_id, {KEEP1.format(v='user_email')} FROM px_user_activities
UNION ALL SELECT 'marketing_interactions', interaction_id, {KEEP1.format(v='customer_email')}
          FROM px_marketing_interactions""")
def masked_other_tables(m):
    """E-mail mask on the four other tables, as marketing sees them."""
    ids = {"orders": "order_id", "support_tickets": "ticket_id",
           "user_activities": "event_id", "marketing_interactions": "interaction_id"}
    out = None
    for t, idc in ids.items():
        col = M.EMAIL_MASKED_COLUMNS[t]
        part = (M.masked_table(m[t].select(idc, col), t, "MARKETING_TEAM")
                .select(F.lit(t).alias("table_name"), F.col(idc).alias("row_id"),
                        F.col(col).alias("email")))
        out = part if out is None else out.unionByName(part)
    return out


@register("json_mask_address", with_tables("px_orders") + """
SELECT order_id, billing_address AS billing_shipping,
       '{"masked":"true","city":"' || json_extract_string(billing_address, '$.city')
       || '","country":"' || json_extract_string(billing_address, '$.country') || '"}' AS billing_other
FROM px_orders""")
def json_mask_address(m):
    """JSON address mask: only masked flag, city and country remain."""
    o = m["orders"]
    return o.select("order_id",
                    M.json_mask_address("billing_address", "SHIPPING").alias("billing_shipping"),
                    M.json_mask_address("billing_address", "SALES").alias("billing_other"))


@register("json_extract", with_tables("px_orders") + """
SELECT order_id, json_extract_string(billing_address, '$.city') AS city,
       json_extract_string(billing_address, '$.country') AS country
FROM px_orders""")
def json_extract(m):
    """Field access on a semi-structured column (``col:city``), via VARIANT."""
    v = F.parse_json("billing_address")
    return m["orders"].select("order_id",
                              F.variant_get(v, "$.city", "string").alias("city"),
                              F.variant_get(v, "$.country", "string").alias("country"))


@register("json_parse", with_tables("px_user_activities") + """
SELECT event_id, CAST(json_extract(event_properties, '$.k') AS BIGINT) AS k,
       json_extract_string(event_properties, '$.missing') AS missing
FROM px_user_activities""")
def json_parse(m):
    """PARSE_JSON of event properties, typed extraction of a field."""
    v = F.try_parse_json("event_properties")
    return m["user_activities"].select(
        "event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"),
        F.try_variant_get(v, "$.missing", "string").alias("missing"))


EMAIL_RE_SQL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"  # fixed value, written out on the oracle side


@register("scalar_functions", canon_sql(with_tables("px_customers") + """
SELECT customer_id,
       upper(email) AS upper_email,
       email LIKE '%@building%' AS like_building,
       email ILIKE '%@BUILDING%' AS ilike_building,
       email NOT LIKE '%@machinery%' AS not_like_machinery,
       first_name || ' ' || last_name AS full_name,
       replace(email, '@', '_AT_') AS replaced_email,
       left(phone_number, 3) AS phone_left,
       right(phone_number, 4) AS phone_right,
       length(last_name) AS name_length,
       repeat('*', 3) AS stars,
       array_to_string(['WITHDRAWN_CONSENT', 'OBJECTION', country_code], ', ') AS joined,
       regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') AS email_like,
       nullif(regexp_extract(address_line1, '\\d+'), '') AS first_number,
       nullif(regexp_extract(city, '\\d{3}'), '') AS three_digits,
       data_retention_until + 30 AS retention_plus_30,
       CAST(data_retention_until + INTERVAL 1 MONTH AS DATE) AS retention_plus_month,
       CAST(data_retention_until - INTERVAL 1 YEAR AS DATE) AS retention_minus_year,
       date_diff('day', DATE '2001-08-01', data_retention_until) AS days_to_retention,
       year(date_of_birth) AS birth_year,
       make_date(year(date_of_birth), 1, 1) AS birth_year_start,
       sha256(email) AS email_sha256,
       coalesce(consent_given_date, created_at) AS consent_or_created,
       TRY_CAST(postal_code AS BIGINT) AS postal_number,
       TRY_CAST(first_name AS BIGINT) IS NULL AS name_not_numeric,
       list_contains(['01', '02', '03'], country_code) AS early_nation,
       len(['01', '02', country_code]) AS three,
       split_part(email, '@', 2) AS email_domain
FROM px_customers""", ["retention_plus_30", "retention_plus_month", "retention_minus_year",
                       "birth_year_start", "consent_or_created"]))
def scalar_functions(m):
    """The scalar function surface of the reference, one column each."""
    c = m["customers"]
    e = F.col("email")
    return c.select(
        "customer_id",
        F.upper(e).alias("upper_email"),
        e.like("%@building%").alias("like_building"),
        e.ilike("%@BUILDING%").alias("ilike_building"),
        (~e.like("%@machinery%")).alias("not_like_machinery"),
        F.concat("first_name", F.lit(" "), "last_name").alias("full_name"),
        F.replace(e, F.lit("@"), F.lit("_AT_")).alias("replaced_email"),
        F.left("phone_number", F.lit(3)).alias("phone_left"),
        F.right("phone_number", F.lit(4)).alias("phone_right"),
        F.length("last_name").alias("name_length"),
        F.repeat(F.lit("*"), 3).alias("stars"),
        F.array_join(F.array(F.lit("WITHDRAWN_CONSENT"), F.lit("OBJECTION"),
                             F.col("country_code")), ", ").alias("joined"),
        C.full_match(e, C.EMAIL_RE).alias("email_like"),
        F.regexp_substr("address_line1", F.lit(r"\d+")).alias("first_number"),
        F.regexp_substr("city", F.lit(r"\d{3}")).alias("three_digits"),
        F.date_add("data_retention_until", 30).alias("retention_plus_30"),
        F.add_months("data_retention_until", 1).alias("retention_plus_month"),
        F.add_months("data_retention_until", -12).alias("retention_minus_year"),
        C.days_between(F.lit(AS_OF), "data_retention_until").alias("days_to_retention"),
        F.year("date_of_birth").alias("birth_year"),
        F.make_date(F.year("date_of_birth"), F.lit(1), F.lit(1)).alias("birth_year_start"),
        F.sha2(e, 256).alias("email_sha256"),
        F.coalesce("consent_given_date", "created_at").alias("consent_or_created"),
        F.col("postal_code").try_cast("long").alias("postal_number"),
        F.col("first_name").try_cast("long").isNull().alias("name_not_numeric"),
        F.array_contains(F.array(F.lit("01"), F.lit("02"), F.lit("03")),
                         F.col("country_code")).alias("early_nation"),
        F.size(F.array(F.lit("01"), F.lit("02"), F.col("country_code"))).alias("three"),
        F.get(F.split(e, "@"), 1).alias("email_domain"),
    )


#: Every column of the customer table, as text.
MELT_COLS = ["customer_id", "email", "first_name", "last_name", "phone_number", "date_of_birth",
             "address_line1", "address_line2", "city", "state_province", "postal_code", "country_code",
             "consent_marketing", "consent_analytics", "consent_given_date", "lawful_basis",
             "data_retention_until", "created_at", "updated_at", "is_deleted", "deleted_at", "pii_classification"]


@register("classify_by_value", with_tables("px_customers") + f"""
SELECT column_name,
       CASE WHEN regexp_full_match(v, '{EMAIL_RE_SQL}') THEN 'EMAIL_ADDRESS'
            WHEN regexp_full_match(v, '\\d{{3}}-\\d{{2}}-\\d{{4}}') THEN 'SSN'
            WHEN regexp_full_match(v, '\\+?\\d{{10,15}}') THEN 'PHONE_NUMBER'
            WHEN regexp_full_match(v, '\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}') THEN 'DATE_OF_BIRTH'
            WHEN upper(column_name) LIKE '%NAME%' THEN 'PERSONAL_NAME'
            WHEN upper(column_name) LIKE '%ADDRESS%' THEN 'POSTAL_ADDRESS'
            WHEN upper(column_name) LIKE '%IP%' THEN 'IP_ADDRESS'
            ELSE 'NON_PII' END AS pii_class,
       count(*) AS n
FROM (""" + "\n UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM px_customers" for c in MELT_COLS)
    + ") GROUP BY ALL")
def classify_by_value(m):
    """Value-based class of every cell of the customer table, counted."""
    c = m["customers"]
    stack = "stack({n}, {args}) as (column_name, v)".format(
        n=len(MELT_COLS),
        args=", ".join(f"'{col}', cast({col} as string)" for col in MELT_COLS))
    long = c.selectExpr(stack)
    return (long.groupBy("column_name", C.classify_by_value("column_name", "v").alias("pii_class"))
            .agg(F.count(F.lit(1)).alias("n")))

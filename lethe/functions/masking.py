"""Role-aware masking expressions.

Each mask is a pure ``Column -> Column`` function of a value and a role.  The
role is a literal in normal use, so Catalyst folds the role test away and the
mask compiles to one regexp/concat expression inside whole-stage codegen; a
role *column* also works (used by tests that check every role at once).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The roles that see each kind of value in clear.
EMAIL_CLEAR = ["ACCOUNTADMIN", "GDPR_ADMIN", "CUSTOMER_SERVICE", "DATA_PROTECTION_OFFICER"]
EMAIL_PARTIAL_2 = ["ANALYTICS_TEAM", "DATA_SCIENTIST"]
EMAIL_PARTIAL_1 = ["MARKETING_TEAM"]
EMAIL_SIMPLE_CLEAR = ["GDPR_ADMIN", "DATA_PROTECTION_OFFICER"]
CONTACT_CLEAR = ["ACCOUNTADMIN", "GDPR_ADMIN", "CUSTOMER_SERVICE"]
ADDRESS_CLEAR = ["ACCOUNTADMIN", "GDPR_ADMIN", "CUSTOMER_SERVICE", "SHIPPING"]
ORDER_EMAIL_CLEAR = ["ACCOUNTADMIN", "GDPR_ADMIN", "CUSTOMER_SERVICE"]
PRIVILEGED = ["ACCOUNTADMIN", "GDPR_ADMIN"]

# Mask patterns and constants.
EMAIL_KEEP2 = r"^(.{2}).*(@.*)$"
EMAIL_KEEP1 = r"^(.).*(@.*)$"
EMAIL_KEEP_REPL = "$1****$2"
EMAIL_CONSTANT = "*****@*****.***"
EMAIL_LOCAL_PART = r".{1,}@"
EMAIL_LOCAL_REPL = "*****@"
DIGIT_RUN = r"\d+"
DIGIT_REPL = "***"
SHORT_PHONE = "***-***-****"

ALL_ROLES = sorted(set(EMAIL_CLEAR + EMAIL_PARTIAL_2 + EMAIL_PARTIAL_1 + ADDRESS_CLEAR
                       + ["SALES", "PUBLIC"]))


def _role(role) -> Column:
    return role if isinstance(role, Column) else F.lit(role)


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def mask_email(val, role) -> Column:
    """Clear for support/compliance roles; 2 or 1 leading characters plus the
    domain for analytics / marketing; a constant for everyone else (NULL
    included)."""
    v, r = _col(val), _role(role)
    return (F.when(r.isin(EMAIL_CLEAR), v)
             .when(r.isin(EMAIL_PARTIAL_2), F.regexp_replace(v, EMAIL_KEEP2, EMAIL_KEEP_REPL))
             .when(r.isin(EMAIL_PARTIAL_1), F.regexp_replace(v, EMAIL_KEEP1, EMAIL_KEEP_REPL))
             .otherwise(F.lit(EMAIL_CONSTANT)))


def mask_email_simple(val, role) -> Column:
    """Documented simpler form: the local part becomes ``*****``."""
    v, r = _col(val), _role(role)
    return F.when(r.isin(EMAIL_SIMPLE_CLEAR), v).otherwise(
        F.regexp_replace(v, EMAIL_LOCAL_PART, EMAIL_LOCAL_REPL))


def mask_phone(val, role) -> Column:
    v, r = _col(val), _role(role)
    return (F.when(r.isin(CONTACT_CLEAR), v)
             .when(v.isNull(), F.lit(None).cast("string"))
             .when(F.length(v) >= 10, F.concat(F.left(v, F.lit(3)), F.lit("-***-"), F.right(v, F.lit(4))))
             .otherwise(F.lit(SHORT_PHONE)))


def mask_address(val, role) -> Column:
    v, r = _col(val), _role(role)
    return (F.when(r.isin(ADDRESS_CLEAR), v)
             .when(v.isNull(), F.lit(None).cast("string"))
             .otherwise(F.regexp_replace(v, DIGIT_RUN, DIGIT_REPL)))


def mask_name(val, role) -> Column:
    v, r = _col(val), _role(role)
    return (F.when(r.isin(CONTACT_CLEAR), v)
             .when(v.isNull(), F.lit(None).cast("string"))
             .when(F.length(v) > 1, F.concat(F.left(v, F.lit(1)), F.repeat(F.lit("*"), F.length(v) - 1)))
             .otherwise(F.lit("*")))


def mask_dob(val, role) -> Column:
    v, r = _col(val), _role(role)
    return (F.when(r.isin(CONTACT_CLEAR), v)
             .when(v.isNull(), F.lit(None).cast("date"))
             .otherwise(F.make_date(F.year(v), F.lit(1), F.lit(1))))


def json_field(doc, path: str) -> Column:
    """``doc:field`` on a JSON text column, as a string (NULL when absent)."""
    return F.get_json_object(_col(doc), f"$.{path}")


def json_mask_address(val, role) -> Column:
    """Keep only city and country of a JSON address, flagged as masked."""
    v, r = _col(val), _role(role)
    # one JSON parse per value yields both fields
    doc = F.from_json(v, "city string, country string")
    city, country = doc.getField("city"), doc.getField("country")
    masked = F.when(city.isNotNull() & country.isNotNull(),
                    F.to_json(F.struct(F.lit("true").alias("masked"), city.alias("city"),
                                       country.alias("country"))))
    return F.when(r.isin(ADDRESS_CLEAR), v).otherwise(masked)


def order_email(val, role) -> Column:
    """E-mail as shown in the privacy-safe orders view."""
    v, r = _col(val), _role(role)
    return F.when(r.isin(ORDER_EMAIL_CLEAR), v).otherwise(
        F.regexp_replace(v, EMAIL_KEEP2, EMAIL_KEEP_REPL))


# Column → mask of the customer table.
CUSTOMER_MASKS = {
    "email": mask_email,
    "phone_number": mask_phone,
    "first_name": mask_name,
    "last_name": mask_name,
    "date_of_birth": mask_dob,
    "address_line1": mask_address,
    "address_line2": mask_address,
}
# E-mail columns of other tables that carry the e-mail mask.
EMAIL_MASKED_COLUMNS = {
    "orders": "customer_email",
    "support_tickets": "customer_email",
    "user_activities": "user_email",
    "marketing_interactions": "customer_email",
}


def apply_masks(df, masks: dict, role):
    """Replace every masked column of ``df`` by its masked value (one select)."""
    return df.select(*[(masks[c](F.col(c), role).alias(c) if c in masks else F.col(c))
                       for c in df.columns])


def masked_customers(customers, role):
    return apply_masks(customers, CUSTOMER_MASKS, role)


def masked_table(df, table: str, role):
    col = EMAIL_MASKED_COLUMNS[table]
    return apply_masks(df, {col: mask_email}, role)

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lethe.functions import masking as M


def _one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


def test_mask_email_roles(spark):
    e = "liv.brandt@post.example"
    assert _one(spark, lambda v: M.mask_email(v, "GDPR_ADMIN"), e) == e
    assert _one(spark, lambda v: M.mask_email(v, "ANALYTICS_TEAM"), e) == "li****@post.example"
    assert _one(spark, lambda v: M.mask_email(v, "MARKETING_TEAM"), e) == "l****@post.example"
    assert _one(spark, lambda v: M.mask_email(v, "SALES"), e) == "*****@*****.***"
    # NULL becomes the constant for everyone without a clear/partial view
    assert _one(spark, lambda v: M.mask_email(v, "SALES"), None) == "*****@*****.***"
    assert _one(spark, lambda v: M.mask_email(v, "DATA_SCIENTIST"), None) is None


def test_mask_email_simple(spark):
    e = "liv.brandt@post.example"
    assert _one(spark, lambda v: M.mask_email_simple(v, "DATA_PROTECTION_OFFICER"), e) == e
    assert _one(spark, lambda v: M.mask_email_simple(v, "SALES"), e) == "*****@post.example"


def test_mask_phone(spark):
    assert _one(spark, lambda v: M.mask_phone(v, "SALES"), "+49-30-12345678") == "+49-***-5678"
    assert _one(spark, lambda v: M.mask_phone(v, "SALES"), "12345") == "***-***-****"
    assert _one(spark, lambda v: M.mask_phone(v, "SALES"), None) is None
    assert _one(spark, lambda v: M.mask_phone(v, "CUSTOMER_SERVICE"), "12345") == "12345"


def test_mask_address_name_dob(spark):
    import datetime as dt
    assert _one(spark, lambda v: M.mask_address(v, "SALES"), "123 Main 45") == "*** Main ***"
    assert _one(spark, lambda v: M.mask_address(v, "SHIPPING"), "123 Main") == "123 Main"
    assert _one(spark, lambda v: M.mask_name(v, "SALES"), "Anna") == "A***"
    assert _one(spark, lambda v: M.mask_name(v, "SALES"), "A") == "*"
    assert _one(spark, lambda v: M.mask_name(v, "SALES"), None) is None
    assert _one(spark, lambda v: M.mask_dob(v, "SALES"), dt.date(1985, 3, 15), "date") == dt.date(1985, 1, 1)


def test_json_mask_address(spark):
    doc = '{"street": "1 A", "city": "Kiel", "country": "DE"}'
    assert _one(spark, lambda v: M.json_mask_address(v, "SALES"), doc) == \
        '{"masked":"true","city":"Kiel","country":"DE"}'
    assert _one(spark, lambda v: M.json_mask_address(v, "SHIPPING"), doc) == doc


local = st.text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789._", min_size=2, max_size=12)


@settings(max_examples=25, deadline=None)
@given(local, st.sampled_from(["example.com", "mail.de", "x.org"]))
def test_unprivileged_never_sees_input(spark, user, domain):
    e = f"{user}@{domain}"
    for role in ["ANALYTICS_TEAM", "MARKETING_TEAM", "SALES", "PUBLIC"]:
        assert _one(spark, lambda v: M.mask_email(v, role), e) != e


def test_masks_take_a_role_column(spark):
    roles = M.ALL_ROLES
    df = spark.createDataFrame([(r, "liv.brandt@post.example") for r in roles], "role string, e string")
    got = {r.role: r.m for r in df.select("role", M.mask_email("e", F.col("role")).alias("m")).collect()}
    assert got["GDPR_ADMIN"] == "liv.brandt@post.example"
    assert got["DATA_SCIENTIST"] == "li****@post.example"
    assert got["MARKETING_TEAM"] == "l****@post.example"
    assert got["SHIPPING"] == "*****@*****.***"

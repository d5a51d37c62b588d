import datetime as dt

from pyspark.sql import functions as F

from lethe.functions import classify as C
from lethe.plans import views as V
from lethe.sources.fixtures import FIXTURE_AS_OF


def _map(spark, expr, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r["r"] for r in df.select(expr(F.col("v")).alias("r")).collect()]


def test_classify_by_name(spark):
    names = ["email", "phone_number", "address_line1", "first_name", "user_name", "ssn",
             "date_of_birth", "customer_id", "ip_address"]
    got = _map(spark, C.classify_by_name, names)
    assert got == ["EMAIL_ADDRESS", "PHONE_NUMBER", "POSTAL_ADDRESS", "PERSONAL_NAME",
                   "POTENTIAL_PII", "SSN", "DATE_OF_BIRTH", "POTENTIAL_PII", "POSTAL_ADDRESS"]
    assert _map(spark, C.sensitivity, got) == ["HIGH", "HIGH", "HIGH", "MEDIUM", "LOW",
                                               "CRITICAL", "CRITICAL", "LOW", "HIGH"]


def test_candidate_filter_omits_birth_unless_intended(spark):
    df = spark.createDataFrame([("date_of_birth",), ("email",)], "v string")
    obs = df.where(C.is_candidate_column("v")).collect()
    intended = df.where(C.is_candidate_column("v", intended=True)).collect()
    assert [r.v for r in obs] == ["email"] and len(intended) == 2


def test_classify_by_value_is_whole_value(spark):
    df = spark.createDataFrame([("note", "mail me at a@b.com please"), ("x", "a@b.com"),
                                ("x", "123-45-6789"), ("x", "+4930123456"), ("x", "1990-01-02"),
                                ("client_ip", "n/a"), ("x", "hello")], "n string, v string")
    got = [r.c for r in df.select(C.classify_by_value("n", "v").alias("c")).collect()]
    assert got == ["NON_PII", "EMAIL_ADDRESS", "SSN", "PHONE_NUMBER", "DATE_OF_BIRTH",
                   "IP_ADDRESS", "NON_PII"]


def test_compliant_view_on_fixtures(fixtures):
    v = V.customers_compliant(fixtures["customers"], fixtures["erasure_requests"], FIXTURE_AS_OF)
    rows = {r.customer_id: r for r in v.collect()}
    assert len(rows) == 12
    assert rows["CUST_009"].gdpr_status == "DELETED"
    assert rows["CUST_002"].gdpr_status == "DELETION_PENDING"
    assert rows["CUST_010"].gdpr_status == "DELETION_PENDING"
    assert rows["CUST_001"].gdpr_status == "ACTIVE"
    assert rows["CUST_010"].retention_status == "OVERDUE_FOR_DELETION"
    assert rows["CUST_009"].consent_status == "ALL_CONSENT_WITHDRAWN"
    assert rows["CUST_005"].consent_status == "NO_CONSENT_RECORD"
    assert rows["CUST_011"].consent_status == "NO_CONSENT_RECORD"
    assert rows["CUST_002"].consent_status == "MARKETING_CONSENT_WITHDRAWN"
    assert rows["CUST_003"].consent_status == "ANALYTICS_CONSENT_WITHDRAWN"
    assert rows["CUST_001"].consent_status == "CONSENTED"


def test_retention_month_end_clamps(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),)], "d date")
    r = df.select(C.retention_status("d", dt.date(2024, 1, 31)).alias("s")).first().s
    assert r == "DUE_FOR_DELETION_SOON"


def test_compliance_status_levels(spark):
    df = spark.createDataFrame([(0,), (2,), (3,)], "n long")
    assert [r.s for r in df.select(C.compliance_status("n").alias("s")).collect()] == \
        ["COMPLIANT", "AT_RISK", "NON_COMPLIANT"]


import re as _re

from hypothesis import given, settings
from hypothesis import strategies as st

_alphabet = "ab1-+@./ 9x"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=_alphabet, max_size=14), min_size=1, max_size=6))
def test_value_classes_match_python_fullmatch(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.c for r in df.select(C.classify_by_value(F.lit("x"), F.col("v")).alias("c")).collect()]

    def py(v):
        for cls, pat in (("EMAIL_ADDRESS", C.EMAIL_RE), ("SSN", C.SSN_RE),
                         ("PHONE_NUMBER", C.PHONE_RE), ("DATE_OF_BIRTH", C.DATE_RE)):
            if _re.fullmatch(pat, v):
                return cls
        return "NON_PII"
    assert got == [py(v) for v in values]

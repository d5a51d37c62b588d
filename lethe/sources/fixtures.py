"""Small invented tables that hold the edge cases of the compliance rules.

Used by expected-value unit tests at ``FIXTURE_AS_OF``.  ``FixtureModel``
offers the same interface as ``ComplianceModel`` so every plan runs on it.
The cases: both consents withdrawn (009), retention expired (010), no consent
date (005, 011), a hold that blocks (002, 006), a hold that may be overridden
(012), an open, a running and a completed request, orders under retention.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from .schemas import LOCATION, conform

FIXTURE_AS_OF = dt.date(2024, 3, 20)


def _at(days_before: int, hour: int = 12) -> dt.datetime:
    """A time some days before the reference date."""
    day = FIXTURE_AS_OF - dt.timedelta(days=days_before)
    return dt.datetime(day.year, day.month, day.day, hour)


def _in(days: int) -> dt.date:
    return FIXTURE_AS_OF + dt.timedelta(days=days)


# (number, mailbox, first, last, city, country, marketing, analytics, consent given days ago, basis, retention ends in days)
_PEOPLE = [
    (1, "liv.brandt@post.example", "Liv", "Brandt", "Kiel", "DE", True, True, 60, "CONSENT", 2400),
    (2, "otto.krohn@mail.example", "Otto", "Krohn", "Metz", "FR", False, True, 30, "LEGITIMATE_INTEREST", 1700),
    (3, "ines.vidal@post.example", "Ines", "Vidal", "Vigo", "ES", True, False, 10, "CONSENT", 2100),
    (4, "enzo.bassi@mail.example", "Enzo", "Bassi", "Bari", "IT", True, True, 75, "CONTRACT", 2450),
    (5, "siv.lund@post.example", "Siv", "Lund", "Umeå", "SE", False, False, None, "LEGITIMATE_INTEREST", 1600),
    (6, "rhea.stone@mail.example", "Rhea", "Stone", "Dayton", "US", True, True, 45, "CONSENT", 2800),
    (7, "noel.park@post.example", "Noel", "Park", "Tulsa", "US", True, False, 55, "CONSENT", 2500),
    (8, "ren.mori@mail.example", "Ren", "Mori", "Nara", "JP", False, True, 15, "LEGITIMATE_INTEREST", 1800),
    (9, "no.consent@post.example", "Uwe", "Falk", "Trier", "DE", False, False, 110, "CONSENT", 620),
    (10, "kept.too.long@mail.example", "Luc", "Favre", "Nancy", "FR", True, True, 800, "CONSENT", -80),
    (11, "young.user@post.example", "Tim", "Busch", "Jena", "DE", False, False, None, "PARENTAL_CONSENT", 730),
    (12, "front.desk@firm.example", "Gwen", "Hale", "Leeds", "GB", True, True, 70, "CONTRACT", 3580),
]
_MAIL = {n: mail for n, mail, *_ in _PEOPLE}


def _cust(n: int) -> str:
    return f"CUST_{n:03d}"


CUSTOMERS = [
    (_cust(n), mail, first, last, f"+{40 + n}-{n}0-55{n:04d}", dt.date(1980 + n, n, 2 * n), f"{n * 11} Example Lane", city,
     city, f"{n:05d}", country, marketing, analytics, None if ago is None else _at(ago), basis, _in(ends))
    for n, mail, first, last, city, country, marketing, analytics, ago, basis, ends in _PEOPLE]
CUSTOMER_COLS = ("customer_id string, email string, first_name string, last_name string, "
                 "phone_number string, date_of_birth date, address_line1 string, city string, "
                 "state_province string, postal_code string, country_code string, "
                 "consent_marketing boolean, consent_analytics boolean, "
                 "consent_given_date timestamp, lawful_basis string, data_retention_until date")


def _addr(n: int) -> str:
    _, _, _, _, city, country, *_ = _PEOPLE[n - 1]
    return (f'{{"street": "{n * 11} Example Lane", "city": "{city}", "postal_code": "{n:05d}", '
            f'"country": "{country}"}}')


# (customer, order of that customer, days ago, amount, currency, status, may be deleted); all under retention
ORDERS = [
    (f"ORD_{n:03d}_{k:03d}", _cust(n), _MAIL[n], _at(ago), amount, currency, "CREDIT_CARD", _addr(n), status, _in(2500), deletable)
    for n, k, ago, amount, currency, status, deletable in [
        (1, 1, 61, 18.50, "EUR", "DELIVERED", True), (1, 2, 6, 240.00, "EUR", "PROCESSING", True),
        (2, 1, 24, 75.25, "EUR", "DELIVERED", False), (3, 1, 18, 12.00, "EUR", "DELIVERED", True),
        (6, 1, 40, 510.10, "USD", "DELIVERED", True), (12, 1, 66, 8200.00, "GBP", "DELIVERED", False)]]
ORDER_COLS = ("order_id string, customer_id string, customer_email string, order_date timestamp, "
              "total_amount double, currency string, payment_method string, "
              "billing_address string, order_status string, legal_retention_until date, "
              "can_be_deleted boolean")

TICKETS = [
    (f"TICK_{n:03d}_001", _cust(n), _MAIL[n], subject, text, priority, status)
    for n, subject, text, priority, status in [
        (1, "Parcel", "Where is my parcel?", "MEDIUM", "RESOLVED"), (2, "Erase me", "Erase all you hold about me.", "HIGH", "OPEN"),
        (3, "Receipt", "The receipt shows a wrong sum.", "LOW", "RESOLVED"), (9, "No more mail", "Stop writing to me.", "MEDIUM", "RESOLVED"),
        (11, "Login", "My login fails since my birthday.", "MEDIUM", "OPEN")]]
TICKET_COLS = ("ticket_id string, customer_id string, customer_email string, subject string, "
               "description string, priority string, status string")

# (customer, event of that customer, type, days ago, analytics consent); is_pseudonymized defaults to false
ACTIVITIES = [
    (f"EVT_{n:03d}_{k:03d}", _cust(n), _MAIL[n], kind, _at(ago), f"198.51.100.{n}", _PEOPLE[n - 1][5], consent)
    for n, k, kind, ago, consent in [
        (1, 1, "view", 66, True), (1, 2, "basket", 65, True), (1, 3, "buy", 61, True), (2, 1, "view", 29, False),
        (3, 1, "view", 20, True), (3, 2, "buy", 18, True), (9, 1, "view", 125, False)]]
ACTIVITY_COLS = ("event_id string, customer_id string, user_email string, event_type string, "
                 "event_timestamp timestamp, ip_address string, country_code string, "
                 "consent_for_analytics boolean")

REQUESTS = [
    ("REQ_2024_001", _cust(9), _MAIL[9], "FULL_ERASURE", "WITHDRAWN_CONSENT", "WEB_FORM", "COMPLETED",
     _at(100), _at(99), _at(98), _at(96), _in(-70), _in(-96), "0f1e2d3c"),
    ("REQ_2024_002", _cust(2), _MAIL[2], "FULL_ERASURE", "OBJECTION", "SUPPORT_TICKET", "IN_PROGRESS",
     _at(17), _at(16), _at(15), None, _in(13), None, None),
    ("REQ_2024_003", _cust(10), _MAIL[10], "FULL_ERASURE", "NO_LONGER_NECESSARY", "API", "SUBMITTED",
     _at(4), None, None, None, _in(26), None, None),
]
REQUEST_COLS = ("request_id string, customer_id string, customer_email string, request_type string, "
                "erasure_reason string, request_source string, status string, "
                "requested_at timestamp, validated_at timestamp, started_at timestamp, "
                "completed_at timestamp, estimated_completion_date date, "
                "actual_completion_date date, verification_hash string")

POLICIES = [
    ("POL_001", _cust(2), "FINANCIAL_TRANSACTIONS", "TAX_COMPLIANCE", 90, _in(-24), _in(2700), "FR", "tax records", False),
    ("POL_002", _cust(12), "ALL_DATA", "LEGAL_INVESTIGATION", 30, _in(-66), _in(900), "GB", "open case", True),
    ("POL_003", _cust(6), "FINANCIAL_TRANSACTIONS", "REGULATORY_REQUIREMENT", 48, _in(-40), _in(1500), "US", "audit trail", False),
]
POLICY_COLS = ("policy_id string, customer_id string, data_category string, retention_reason string, "
               "retention_period_months long, retention_start_date date, retention_end_date date, "
               "jurisdiction string, legal_reference string, can_override_gdpr boolean")

_ROWS = {
    "customers": (CUSTOMERS, CUSTOMER_COLS),
    "orders": (ORDERS, ORDER_COLS),
    "support_tickets": (TICKETS, TICKET_COLS),
    "user_activities": (ACTIVITIES, ACTIVITY_COLS),
    "erasure_requests": (REQUESTS, REQUEST_COLS),
    "retention_policies": (POLICIES, POLICY_COLS),
}


def literal_table(spark: SparkSession, name: str) -> DataFrame:
    rows, cols = _ROWS[name]
    created = dt.datetime(FIXTURE_AS_OF.year, FIXTURE_AS_OF.month, FIXTURE_AS_OF.day)
    from pyspark.sql import functions as F
    return conform(spark.createDataFrame(rows, cols), name, F.lit(created))


class FixtureModel:
    """The invented tables behind the ``ComplianceModel`` interface."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._dfs: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._dfs:
            self._dfs[name] = literal_table(self.spark, name)
        return self._dfs[name]

    def names(self) -> list[str]:
        return list(_ROWS)

    @staticmethod
    def location(name: str) -> tuple[str, str]:
        return LOCATION[name]

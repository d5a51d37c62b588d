"""Expected values of the reports on the invented fixture rows."""
from lethe.plans import reports as R
from lethe.sources.fixtures import FIXTURE_AS_OF


def test_dashboard_on_fixtures(fixtures):
    d = R.dashboard(fixtures["erasure_requests"], FIXTURE_AS_OF).first()
    assert (d.pending_requests, d.in_progress_requests, d.completed_requests) == (1, 1, 1)
    assert (d.overdue_requests, d.due_soon_requests) == (0, 0)
    assert (d.avg_processing_days, d.max_processing_days) == (4.0, 4)
    assert (d.requests_last_7_days, d.completions_last_7_days) == (1, 0)
    assert d.overall_compliance_status == "COMPLIANT"


def test_retention_compliance_on_fixtures(fixtures):
    rows = {r.data_category: r for r in
            R.retention_compliance(fixtures["customers"], fixtures["orders"], FIXTURE_AS_OF).collect()}
    c, t = rows["customers"], rows["transactions"]
    assert (c.total_records, c.overdue_for_deletion, c.due_soon) == (12, 1, 0)
    assert (c.marketing_consent_withdrawn, c.analytics_consent_withdrawn) == (5, 5)
    assert (t.total_records, t.overdue_for_deletion, t.due_soon) == (6, 0, 0)


def test_legal_holds_on_fixtures(fixtures):
    got = {r.customer_email: r.hold_count for r in
           R.legal_hold_count(fixtures["retention_policies"], fixtures["customers"],
                              FIXTURE_AS_OF).collect()}
    # CUST_012's hold may be overridden, so only CUST_002 and CUST_006 are blocked
    assert got == {"otto.krohn@mail.example": 1, "rhea.stone@mail.example": 1}
    anyhold = R.legal_hold_count(fixtures["retention_policies"], fixtures["customers"],
                                 FIXTURE_AS_OF, honour_override=False).count()
    assert anyhold == 3


def test_topk_and_latest_active_on_fixtures(fixtures):
    top = [r.request_id for r in R.requests_topk(fixtures["erasure_requests"], FIXTURE_AS_OF, 2).collect()]
    assert top == ["REQ_2024_003", "REQ_2024_002"]
    la = {r.customer_email: r.request_id for r in
          R.latest_active_request(fixtures["erasure_requests"]).collect()}
    assert la == {"no.consent@post.example": "REQ_2024_001", "otto.krohn@mail.example": "REQ_2024_002"}


def test_views_and_policies_on_fixtures(fixtures):
    from lethe.operators import policies as P
    from lethe.plans import views as V
    comp = V.customers_compliant(fixtures["customers"], fixtures["erasure_requests"], FIXTURE_AS_OF)
    orders = {r.order_id: r for r in V.orders_safe(fixtures["orders"], comp, "ANALYTICS_TEAM").collect()}
    assert len(orders) == 6
    assert orders["ORD_001_001"].customer_email == "li****@post.example"
    assert orders["ORD_001_001"].billing_address == '{"masked":"true","city":"Kiel","country":"DE"}'
    acts = V.activities_safe(fixtures["user_activities"], "ANALYTICS_TEAM")
    assert acts.count() == 5  # two events lack analytics consent, none is pseudonymized
    assert V.activities_safe(fixtures["user_activities"], "GDPR_ADMIN").count() == 7
    visible = P.apply_row_policies(fixtures["user_activities"], "user_activities", "CUSTOMER_SERVICE",
                                   fixtures["erasure_requests"])
    assert visible.count() == 6  # the erased subject's event is hidden
    marketing = P.apply_row_policies(fixtures["customers"], "customers", "MARKETING_TEAM",
                                     fixtures["erasure_requests"])
    assert sorted(r.customer_id for r in marketing.collect()) == [
        "CUST_001", "CUST_003", "CUST_004", "CUST_006", "CUST_007", "CUST_010", "CUST_012"]

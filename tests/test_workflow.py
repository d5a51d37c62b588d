from pyspark.sql import functions as F

from lethe.plans import erasure as X
from lethe.plans import requests as Q
from lethe.plans import discovery as D
from lethe.sources.fixtures import FIXTURE_AS_OF


def test_process_plan_on_fixtures(spark, fixtures):
    ids = spark.createDataFrame([("REQ_2024_001",), ("REQ_2024_002",), ("REQ_2024_003",),
                                 ("REQ_NOPE",)], "request_id string")
    plan = Q.process_plan(ids, fixtures["erasure_requests"], fixtures["retention_policies"],
                          fixtures["customers"], FIXTURE_AS_OF)
    got = {r.request_id: r.decision for r in plan.collect()}
    assert got == {"REQ_2024_001": "NOT_PROCESSABLE", "REQ_2024_002": "NOT_PROCESSABLE",
                   "REQ_2024_003": "IN_PROGRESS", "REQ_NOPE": "NOT_FOUND"}


def test_hold_blocks_processable_request(spark, fixtures):
    # CUST_002 has a non-overridable hold until 2031: a fresh SUBMITTED request is rejected
    req = fixtures["erasure_requests"].withColumn(
        "status", F.when(F.col("request_id") == "REQ_2024_002", "SUBMITTED").otherwise(F.col("status")))
    ids = spark.createDataFrame([("REQ_2024_002",)], "request_id string")
    plan = Q.process_plan(ids, req, fixtures["retention_policies"], fixtures["customers"], FIXTURE_AS_OF)
    r = plan.first()
    assert r.decision == "REJECTED" and r.hold_count == 1 and r.message == Q.MSG_HOLD


def test_submit_requests_outcomes(spark, fixtures):
    cand = spark.createDataFrame([
        ("liv.brandt@post.example", "WITHDRAWN_CONSENT", 1),
        ("liv.brandt@post.example", "OBJECTION", 2),        # second in the same batch
        ("otto.krohn@mail.example", "OBJECTION", 1),        # open request exists
        ("maria.garcia@email.es", "JUST_BECAUSE", 1),    # invalid ground
        ("nobody@nowhere.org", "CHILD_CONSENT", 1),      # accepted, no customer record
        (None, "OBJECTION", 1),                           # no subject at all
    ], "customer_email string, erasure_reason string, submission_seq long")
    out = Q.submit_requests(cand, fixtures["customers"], fixtures["erasure_requests"], FIXTURE_AS_OF)
    got = {(r.customer_email, r.submission_seq): r for r in out.collect()}
    assert got[("liv.brandt@post.example", 1)].outcome == "ACCEPTED"
    assert got[("liv.brandt@post.example", 1)].customer_id == "CUST_001"
    assert got[("liv.brandt@post.example", 1)].request_id.startswith("REQ_2024_")
    assert got[("liv.brandt@post.example", 2)].outcome == "ACTIVE_REQUEST_EXISTS"
    assert got[("otto.krohn@mail.example", 1)].outcome == "ACTIVE_REQUEST_EXISTS"
    assert got[("maria.garcia@email.es", 1)].message.startswith("ERROR: Invalid GDPR grounds")
    assert got[("nobody@nowhere.org", 1)].outcome == "ACCEPTED"
    assert got[("nobody@nowhere.org", 1)].customer_id is None
    assert got[(None, 1)].outcome == "MISSING_EMAIL"
    rows = Q.accepted_request_rows(out, FIXTURE_AS_OF)
    assert rows.count() == 2 and set(rows.columns) >= {"request_id", "status", "requested_at"}


def test_coordinate_processors(spark, fixtures):
    subj = spark.createDataFrame([("no.consent@post.example",), ("young.user@post.example",)],
                                 "customer_email string")
    n = Q.coordinate_processors(subj, fixtures["erasure_requests"], FIXTURE_AS_OF)
    assert n.count() == 5
    assert {r.third_party_name for r in n.collect()} == set(Q.PROCESSORS)
    out = {r.customer_email: r.message for r in
           Q.coordination_outcome(subj, fixtures["erasure_requests"]).collect()}
    assert out["young.user@post.example"] == Q.MSG_NO_ACTIVE


def test_subject_status(spark, fixtures):
    subj = spark.createDataFrame([("no.consent@post.example",), ("liv.brandt@post.example",)],
                                 "customer_email string")
    st = {r.customer_email: r for r in
          Q.subject_status(subj, fixtures["erasure_requests"], fixtures["customers"]).collect()}
    assert st["no.consent@post.example"].deletion_completed is True
    assert st["liv.brandt@post.example"].has_active_request is False
    assert st["liv.brandt@post.example"].marketing is True
    obj = Q.subject_status_object(
        Q.subject_status(subj, fixtures["erasure_requests"], fixtures["customers"])).collect()
    assert all(r.compliance_status.startswith("{") for r in obj)


def test_audit_hash_round_trip(spark):
    ev = spark.createDataFrame(
        [("ERASURE_REQUEST_SUBMITTED", "a@b.com", "x", "{}", None)],
        "event_type string, customer_email string, event_description string, event_data string, "
        "event_timestamp timestamp").withColumn("event_timestamp", F.lit("2024-03-20 10:00:00").cast("timestamp"))
    a = Q.audit_append(ev)
    v = Q.audit_verify(a).first()
    assert v.hash_matches is True
    tampered = Q.audit_verify(a.withColumn("customer_email", F.lit("c@d.com"))).first()
    assert tampered.hash_matches is False


def test_erase_then_discover_is_empty(spark, fixtures):
    subj = spark.createDataFrame([("kept.too.long@mail.example",), ("liv.brandt@post.example",)],
                                 "customer_email string")
    before = fixtures["customers"]
    kept, affected = X.erase_delete(before, subj, FIXTURE_AS_OF)
    assert kept.count() + affected.agg(F.sum("records_affected")).first()[0] == before.count()
    assert kept.join(subj, kept.email == subj.customer_email, "left_semi").count() == 0
    again, aff2 = X.erase_delete(kept, subj, FIXTURE_AS_OF)
    assert again.count() == kept.count() and aff2.count() == 0  # erasing twice = once


def test_row_holds_are_honoured(spark, fixtures):
    subj = spark.createDataFrame([("otto.krohn@mail.example",), ("liv.brandt@post.example",)],
                                 "customer_email string")
    kept, _ = X.erase_delete(fixtures["orders"], subj, FIXTURE_AS_OF, honour_row_holds=True)
    # every fixture order is under legal retention until 2031+: nothing is deleted
    assert kept.count() == 6
    kept2, _ = X.erase_delete(fixtures["orders"], subj, FIXTURE_AS_OF, honour_row_holds=False)
    assert kept2.count() == 3


def test_pseudonymize_and_verify(spark, fixtures):
    subj = spark.createDataFrame([("liv.brandt@post.example",)], "customer_email string")
    acts = fixtures["user_activities"]
    after, affected = X.erase_pseudonymize(acts, subj, salt="s")
    rows = [r for r in after.collect() if r.customer_id == "CUST_001"]
    assert all(r.user_email.startswith("PSEUDONYM_") and r.is_pseudonymized for r in rows)
    assert affected.first().records_affected == 3
    full = "ANALYTICS_DB.EVENTS.USER_ACTIVITIES"
    counts = X.verify_counts({full: acts}, {full: after}, [(full, "user_email")], subj)
    v = X.verify_deletion(counts).first()
    assert (v.records_before, v.records_after, v.deletion_verified) == (3, 0, True)


def test_discovery_on_fixtures(spark, fixtures):
    subj = spark.createDataFrame([("liv.brandt@post.example",)], "customer_email string")
    d = D.discover_subjects(fixtures, subj)
    got = {(r.table_name, r.column_name): r.records_found for r in d.collect()}
    assert got == {("CUSTOMERS", "EMAIL"): 1, ("ORDERS", "CUSTOMER_EMAIL"): 2,
                   ("SUPPORT_TICKETS", "CUSTOMER_EMAIL"): 1, ("USER_ACTIVITIES", "USER_EMAIL"): 3}
    # the shuffle path (subject set treated as large) gives the same answer
    d2 = D.discover_subjects(fixtures, subj, max_broadcast_rows=0)
    assert sorted(map(tuple, d2.collect())) == sorted(map(tuple, d.collect()))
    s = D.discovery_summary(d).first()
    assert (s.total_records, s.systems_affected) == (7, 2)


def test_intended_discovery_lists_birth_column(spark, fixtures):
    subj = spark.createDataFrame([("liv.brandt@post.example",)], "customer_email string")
    d = D.discover_subjects(fixtures, subj, mode="intended")
    cols = {(r.table_name, r.column_name, r.pii_classification) for r in d.collect()}
    assert ("CUSTOMERS", "DATE_OF_BIRTH", "DATE_OF_BIRTH") in cols


def test_access_audit_and_redaction(spark):
    log = spark.createDataFrame([(1, "select * from customer where email = 'a.b@x.com'"),
                                 (2, "select 1"), (3, "personal data of c@d.org, call 123-45-6789")],
                                "id long, q string")
    a = D.access_audit(log, "q", "id", ["id"]).collect()
    assert [(r.id, r.customer_email_accessed) for r in a] == [(3, "c@d.org"), (1, "a.b@x.com")]
    red = D.pii_text_redact(log, "id", "q").where("id = 3").first()
    assert red.redacted_text == "personal data of [EMAIL], call [SSN]"
    assert (red.email_found, red.ssn_found) == (1, 1)


def test_full_scenario_on_fixtures(spark, fixtures):
    from lethe.plans.scenario import full_scenario, scenario_summary
    from lethe.session import scratch_path
    from lethe.sources.state import StateFolder
    subj = spark.createDataFrame([("liv.brandt@post.example",), ("otto.krohn@mail.example",),
                                  ("rhea.stone@mail.example",)], "customer_email string")
    state = StateFolder(spark, scratch_path(spark, "scenario"))
    steps = full_scenario(fixtures, subj, FIXTURE_AS_OF, "s", state=state)
    got = {r.customer_email: r for r in scenario_summary(steps).collect()}
    anna = got["liv.brandt@post.example"]
    assert (anna.submit_outcome, anna.decision, anna.notifications) == ("ACCEPTED", "IN_PROGRESS", 5)
    assert anna.records_discovered == 7 and anna.completed_after is True
    # an open request already exists for Jean; John is under a legal hold
    assert got["otto.krohn@mail.example"].submit_outcome == "ACTIVE_REQUEST_EXISTS"
    assert got["rhea.stone@mail.example"].decision == "REJECTED"
    assert state.read("customers").where("email = 'liv.brandt@post.example'").count() == 0
    d = steps["dashboard"].first()
    assert d.completed_requests >= 1
    # verified against the tables as they were before the erasure
    assert anna.verification == "NOT_VERIFIED"  # her orders are under legal retention (row holds)
    v = {r.table_name: r for r in steps["verification"].where(
        "customer_email = 'liv.brandt@post.example'").collect()}
    assert v["CUSTOMER_DATA_DB.CORE.CUSTOMERS"].deletion_verified is True
    assert v["CUSTOMER_DATA_DB.TRANSACTIONS.ORDERS"].records_after == 2
    audit = {(r.event_type, r.customer_email) for r in steps["audit"].collect()}
    assert ("ERASURE_REQUEST_SUBMITTED", "liv.brandt@post.example") in audit
    assert ("ERASURE_REQUEST_COMPLETED", "liv.brandt@post.example") in audit
    assert ("THIRD_PARTY_COORDINATION_INITIATED", "liv.brandt@post.example") in audit


def test_a_second_batch_keeps_the_first_ones_erasure(spark, model):
    """Two batches on one state, the same day: nobody of the first comes back,
    both complete, and the log holds both."""
    from lethe.plans.scenario import full_scenario
    from lethe.session import scratch_path
    from lethe.sources.derived import AS_OF
    from lethe.sources.state import StateFolder
    held = {r["customer_id"] for r in model["retention_policies"].collect()}
    busy = {r["customer_email"] for r in model["erasure_requests"].collect()}
    free = sorted(r["email"] for r in model["customers"].collect() if r["customer_id"] not in held and r["email"] not in busy)[:4]
    state = StateFolder(spark, scratch_path(spark, "two-batches"))
    for emails in (free[:2], free[2:]):
        subj = spark.createDataFrame([(e,) for e in emails], "customer_email string")
        steps = full_scenario(model, subj, AS_OF, "s", state=state)
        assert {r.decision for r in steps["plan"].collect()} == {"IN_PROGRESS"}
        assert steps["verification"].count() > 0
    left = {r["email"] for r in state.read("customers").collect()}
    assert not left & set(free) and len(left) == 150 - 4
    done = state.read("erasure_requests").where("status = 'COMPLETED'").select("customer_email").collect()
    assert set(free) <= {r[0] for r in done}
    ids = {r["customer_email"]: r["request_id"] for r in state.read("erasure_requests").collect() if r["customer_email"] in free}
    logged = {r["request_id"] for r in state.read("erasure_operations").collect()}
    assert set(ids.values()) <= logged
    assert {r["customer_email"] for r in state.read("workflow_audit").collect()} == set(free)
    assert state.read("third_party_notifications").count() == 4 * 5


def test_state_survives_a_writer_that_dies(spark, model):
    from lethe.session import scratch_path
    from lethe.sources.state import StateFolder
    state = StateFolder(spark, scratch_path(spark, "state-crash"))
    one, two = spark.range(3), spark.range(5)
    state.append("t", one)
    state.stage("t", two)
    assert state.read("t").count() == 3  # staged, not published
    state.stage("u", two)
    assert not state.has("u")
    state.publish("t")
    assert state.read("t").count() == 5
    state.publish("t")  # nothing staged: stays
    assert state.read("t").count() == 5 and not state.has("other")
    state.append("t", one)
    assert state.read("t").count() == 8


def test_subject_without_rows_completes(spark, fixtures):
    log = spark.createDataFrame([], "request_id string, operation_status string, target_database string, "
                                    "target_schema string, target_table string, records_affected long")
    done = Q.complete_requests(fixtures["erasure_requests"], log, FIXTURE_AS_OF,
                               fixtures["erasure_requests"].limit(1).select("request_id")).first()
    assert (done.status, done.deletion_summary) == ("COMPLETED", "{}")


def test_pseudonymize_only_the_subjects_own_column(spark):
    df = spark.createDataFrame([(1, "a@x.org", "b@x.org"), (2, "b@x.org", None), (3, "a@x.org", "c@x.org")],
                               "id long, email string, other_email string")
    subj = spark.createDataFrame([("a@x.org",), ("c@x.org",)], "customer_email string")
    after, affected = X.erase_pseudonymize(df, subj, "s")
    rows = {r.id: r for r in after.collect()}
    assert rows[1].email.startswith("PSEUDONYM_") and rows[1].other_email == "b@x.org"
    assert rows[2].email == "b@x.org" and rows[2].other_email is None
    assert rows[3].email.startswith("PSEUDONYM_") and rows[3].other_email.startswith("PSEUDONYM_")
    assert {r.customer_email: r.records_affected for r in affected.collect()} == {"a@x.org": 2, "c@x.org": 1}


def test_many_hot_keys_spread_over_tasks(spark):
    """Nine tenths of the rows on one key, more hot keys beside it: no task of
    the newest-request aggregate's join holds them all."""
    from pyspark.sql import functions as F
    from lethe.operators.keyed import latest_per_key
    rows = spark.range(0, 40_000, numPartitions=4).select(
        F.when(F.col("id") % 10 > 0, F.lit("hot@x.org")).otherwise(F.concat(F.lit("u"), F.col("id") % 7)).alias("k"),
        (F.col("id") % 3).alias("t"), "id")
    got = latest_per_key(rows, "k", "t")
    assert got.count() == rows.join(rows.groupBy("k").agg(F.max("t").alias("m")), "k").where("t = m").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["n"] for r in latest_per_key(rows, "k", "t").groupBy(F.spark_partition_id().alias("p"))
                 .agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 8 and max(sizes) < 0.35 * sum(sizes)


def test_failed_table_is_logged_and_blocks_completion(spark, fixtures):
    from lethe.sources.fixtures import FixtureModel

    class Broken(FixtureModel):
        def __getitem__(self, name):
            df = super().__getitem__(name)
            if name == "support_tickets":
                # a table whose subject column cannot be resolved
                return df.withColumnRenamed("customer_email", "customer_email_x").select(
                    "ticket_id", F.col("customer_email_x").alias("customer_email"), "missing_col")
            return df

    model = Broken(spark)
    subj = spark.createDataFrame([("liv.brandt@post.example",)], "customer_email string")
    planned = X.plan_erasure(model, subj, FIXTURE_AS_OF, "s")
    assert planned["support_tickets"]["status"] == "FAILED"
    reqs = spark.createDataFrame([("REQ_X", "liv.brandt@post.example")], "request_id string, customer_email string")
    log = X.operation_log(planned, reqs)
    failed = log.where("operation_status = 'FAILED'").collect()
    assert len(failed) == 1 and failed[0].target_table == "SUPPORT_TICKETS" and failed[0].error_message
    full = fixtures["erasure_requests"].unionByName(
        fixtures["erasure_requests"].where("request_id = 'REQ_2024_003'")
        .withColumn("request_id", F.lit("REQ_X")).withColumn("customer_email", F.lit("liv.brandt@post.example")))
    done = Q.complete_requests(full, log, FIXTURE_AS_OF).first()
    assert done.status == "IN_PROGRESS" and done.completed_at is None


def test_command_line_runs(spark, capsys):
    from lethe.__main__ import main
    main(["dashboard", "--data", "/root/testdata/sf0.001"])
    main(["status", "--data", "/root/testdata/sf0.001", "--email", "user10@automobile.example.com"])
    out = capsys.readouterr().out
    assert "overall_compliance_status" in out and "has_active_request" in out

from lethe.operators import policies as P
from lethe.streaming import operators as S
from lethe.plans import reports as R
from lethe.sources import derived

SF = "/root/testdata/sf0.001"


class _Streamed:
    def __init__(self, model):
        self.model = model

    def __getitem__(self, name):
        if name == "events":
            return S.read_stream(self.model.spark, SF, "events")
        return self.model.tables[name]


def test_stream_suppress_equals_batch(spark, model):
    acts = derived.user_activities(_Streamed(model)).select("event_id", "user_email")
    streamed = S.run_batches(acts, "t_suppress",
                             lambda b: S.suppress_erased(b, "user_email", model["erasure_requests"]))
    batch = P.rap_erased(model["user_activities"], "user_email", model["erasure_requests"],
                         "SALES").select("event_id", "user_email")
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_stream_audit_daily_equals_batch(spark, model):
    audit = derived.gdpr_audit_log(_Streamed(model))
    streamed = S.audit_daily_exact(S.run_to_table(S.audit_daily_counts(audit), "t_audit", "complete"))
    batch = R.audit_summary(model["gdpr_audit_log"], derived.EVENTS_AS_OF, months=3)
    key = ["audit_date", "event_type", "event_count", "unique_customers", "unique_users"]
    assert sorted(streamed.select(*key).collect()) == sorted(batch.select(*key).collect())


def test_audit_window_drops_late_rows_in_append_mode(spark):
    """Four files arrive one per micro-batch.  The day-1 window is emitted
    once the watermark (max event time - 1 day) passes its end; an event for
    day 1 arriving after that is dropped, and windows the watermark has not
    closed (day 9) are not emitted."""
    import datetime as dt
    import time
    from lethe.session import scratch_path
    root = scratch_path(spark, "late-audit")
    schema = ("audit_id string, event_type string, event_timestamp timestamp, "
              "customer_email string, user_name string")
    batches = [
        [("a1", "LOGIN", dt.datetime(2024, 1, 1, 10), "x@e.org", "u1"),
         ("a2", "LOGIN", dt.datetime(2024, 1, 1, 11), "y@e.org", "u1")],
        [("a3", "LOGIN", dt.datetime(2024, 1, 5, 9), "x@e.org", "u2")],
        [("a4", "LOGIN", dt.datetime(2024, 1, 6, 9), "x@e.org", "u2")],
        [("a5", "LOGIN", dt.datetime(2024, 1, 1, 12), "z@e.org", "u3"),   # late
         ("a6", "LOGIN", dt.datetime(2024, 1, 9, 9), "x@e.org", "u2")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/b{i}")
        time.sleep(1.1)  # files are taken in modification-time order
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(f"{root}/in"))
    out = S.run_to_table(S.audit_daily(stream, "1 day"), "late", "append")
    got = sorted((r.audit_date.isoformat(), r.event_count, r.unique_customers) for r in out.collect())
    assert got == [("2024-01-01", 2, 2), ("2024-01-05", 1, 1), ("2024-01-06", 1, 1)]


def test_stream_suppress_shuffle_path(spark, model):
    """Above the broadcast bound the streaming anti join takes the shuffle
    path (no hot-key pass on a stream) and gives the same rows."""
    from lethe.operators.keyed import not_in
    acts = derived.user_activities(_Streamed(model)).select("event_id", "user_email")
    done = model["erasure_requests"].where("status = 'COMPLETED'").select("customer_email")
    streamed = S.run_to_table(not_in(acts, "user_email", done, "customer_email", max_rows=0),
                              "t_suppress_shuffle")
    batch = P.rap_erased(model["user_activities"], "user_email", model["erasure_requests"],
                         "SALES").select("event_id", "user_email")
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_stream_audit_daily_sketch_is_close_to_exact(spark, model):
    """The default (bounded-state) form keeps HLL sketches: distinct counts
    within a few percent of the exact ones; event counts exact."""
    audit = derived.gdpr_audit_log(_Streamed(model))
    approx = {(r.audit_date, r.event_type): r for r in
              S.run_to_table(S.audit_daily(audit), "t_audit_hll", "complete").collect()}
    exact = {(r.audit_date, r.event_type): r for r in
             R.audit_summary(model["gdpr_audit_log"], derived.EVENTS_AS_OF, months=3).collect()}
    assert approx.keys() == exact.keys()
    for k, e in exact.items():
        a = approx[k]
        assert a.event_count == e.event_count
        assert abs(a.unique_customers - e.unique_customers) <= max(1, 0.05 * e.unique_customers)


def test_sketches_of_late_batches_are_united(spark):
    """Batches in any order, one of them days late: counts are exact, distinct counts within 5 %."""
    import datetime as dt
    day = dt.datetime(2024, 1, 1)
    rows = [(day + dt.timedelta(hours=i % 72), "LOGIN" if i % 3 else "EXPORT", f"u{i % 700}" if i % 10 else None, f"a{i % 5}")
            for i in range(6000)]
    batches = [rows[i::4] for i in (2, 0, 3, 1)]
    schema = "event_timestamp timestamp, event_type string, customer_email string, user_name string"
    stored = None
    for b in batches:
        part = S.audit_day_sketches(spark.createDataFrame(b, schema))
        stored = part if stored is None else stored.unionByName(part)
    got = {(r["audit_date"], r["event_type"]): r for r in S.audit_days(stored).collect()}
    want = {}
    for at, kind, who, user in rows:
        w = want.setdefault((at.date(), kind), [0, set(), set(), at, at])
        w[0] += 1
        w[1].update({who} - {None})
        w[2].add(user)
        w[3], w[4] = min(w[3], at), max(w[4], at)
    assert got.keys() == want.keys()
    for k, (n, customers, users, first, last) in want.items():
        assert (got[k]["event_count"], got[k]["unique_users"], got[k]["first_event"], got[k]["last_event"]) == (n, len(users), first, last)
        assert abs(got[k]["unique_customers"] - len(customers)) <= max(1, 0.05 * len(customers))


def test_registered_stream_summary_is_close_to_exact(spark, model):
    from pyspark.sql import functions as F

    from lethe.registry.q_streaming import _activity_stream
    _, audit = _activity_stream(model)
    got = {(r["audit_date"], r["event_type"]): r for r in S.audit_days(S.run_batches(audit, "t_sketches", S.audit_day_sketches)).collect()}
    exact = model["gdpr_audit_log"].groupBy(F.to_date("event_timestamp").alias("d"), "event_type").agg(
        F.count_distinct("customer_email").alias("c"), F.count_distinct("user_name").alias("u")).collect()
    assert len(got) == len(exact)
    for r in exact:
        for sketch, n in ((got[r["d"], r["event_type"]]["unique_customers"], r["c"]), (got[r["d"], r["event_type"]]["unique_users"], r["u"])):
            assert abs(sketch - n) <= max(1, 0.05 * n)

"""Written erasures, erasure along keys, and runs that die and are run again."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from lethe.plans import erasure as X
from lethe.plans.scenario import full_scenario
from lethe.session import scratch_path
from lethe.sources.derived import AS_OF
from lethe.sources.fixtures import FixtureModel
from lethe.sources.state import StateFolder

DAY = dt.date(2024, 3, 20)
LIV = "liv.brandt@post.example"


class Linked(FixtureModel):
    """With the tables that name a person by a key only."""

    def __getitem__(self, name):
        orders = [r[0] for r in FixtureModel(self.spark)["orders"].select("order_id").orderBy("order_id").collect()]
        rows, cols = {
            "order_items": ([(f"I{i}", orders[i % len(orders)]) for i in range(9)] + [("I9", None)], "order_item_id string, order_id string"),
            "user_preferences": ([("P1", "CUST_001"), ("P2", "CUST_001"), ("P3", "CUST_002"), ("P4", None)],
                                 "preference_id string, customer_id string"),
            "customer_ml_features": ([("F1", "CUST_001"), ("F2", "CUST_003"), ("F3", None)], "feature_id string, customer_id string"),
        }.get(name, (None, None))
        return super().__getitem__(name) if rows is None else self.spark.createDataFrame(rows, cols)

    def names(self):
        return ["customer_ml_features", "order_items", *super().names(), "user_preferences"]  # children may come first


@pytest.fixture
def linked(spark):
    return Linked(spark)


def people(spark, *emails):
    return spark.createDataFrame([(e,) for e in emails], "customer_email string")


def total(df, col="records_affected"):
    return {r["customer_email"]: r[col] for r in df.collect()}


@pytest.mark.parametrize("operation", ["DELETE", "PSEUDONYMIZE"])
def test_one_write_gives_the_table_the_log_and_the_counts(spark, operation):
    df = spark.createDataFrame([(1, "a@x.example", "b@x.example", False), (2, "c@x.example", None, True), (3, None, None, True),
                                (4, "a@x.example", None, None), (5, "A@x.example", "a@x.example", True)],
                               "row_id long, customer_email string, other_email string, can_be_deleted boolean")
    subjects = people(spark, "a@x.example", "c@x.example", "nobody@x.example")
    cols = X.email_columns(df)
    marked = X.mark_rows(df, subjects, operation, DAY, cols=cols)
    assert marked._jdf.queryExecution().executedPlan().toString().count("ExistingRDD") == 1 + len(cols)  # the table once, the set by column
    done = X.write_erased(marked, df.columns, operation, "s", cols, scratch_path(spark, "one-write"))
    plain = (X.erase_delete(df, subjects, DAY) if operation == "DELETE" else X.erase_pseudonymize(df, subjects, "s"))
    assert sorted(map(tuple, done["table"].collect()), key=repr) == sorted(map(tuple, plain[0].collect()), key=repr)
    assert done["table"].columns == df.columns
    assert total(X.rows_per_subject(done["log"].where("__hit"))) == total(plain[1])
    hit = {1, 2, 4, 5} - ({1} if operation == "DELETE" else set())  # row 1 is held
    assert done["rows"] == {"rows_written": 5 if operation == "PSEUDONYMIZE" else 5 - len(hit), "rows_affected": len(hit)}
    assert {r["row_id"] for r in done["log"].collect()} == {1, 2, 4, 5}


def test_a_table_of_which_nothing_is_left_keeps_its_columns(spark):
    df = spark.createDataFrame([(1, "a@x.example")], "row_id long, customer_email string")
    marked = X.mark_rows(df, people(spark, "a@x.example"), "DELETE", DAY)
    state = StateFolder(spark, scratch_path(spark, "all-gone"))
    X.write_erased(marked, df.columns, "DELETE", "", ["customer_email"], state.next_path("t"))
    state.commit(["t"])
    assert state.read("t").columns == df.columns and state.read("t").count() == 0


def test_verification_by_signed_rows_equals_an_outer_join(spark, linked):
    subj = people(spark, LIV, "otto.krohn@mail.example", "kept.too.long@mail.example")
    planned = X.plan_erasure(linked, subj, DAY, "s")
    names = {X.full_name(linked, n): n for n, e in planned.items() if e["status"] == "SUCCESS" and e["cols"]}
    want = {}
    for full, name in names.items():
        for side, table in (("b", linked[name]), ("a", planned[name]["table"])):
            for c in planned[name]["cols"]:
                who = subj.select(F.col("customer_email").alias("who"))
                for r in table.select(F.col(c).alias("c")).join(who, F.col("c") == F.col("who")).groupBy("who").count().collect():
                    want.setdefault((full, r[0]), {"b": 0, "a": 0})[side] += r[1]
    scope = [(full, c) for full, n in names.items() for c in planned[n]["cols"]]
    both = X.verify_counts({f: linked[n] for f, n in names.items()}, {f: planned[n]["table"] for f, n in names.items()}, scope, subj)
    as_dict = lambda df: {(r["table_name"], r["customer_email"]): {"b": r["records_before"], "a": r["records_after"]} for r in df.collect()}
    assert as_dict(both) == want
    for counts in (X.verify_planned(planned, linked), X.verify_planned(planned, linked, subjects=subj)):
        got = as_dict(counts)
        assert {k: v for k, v in got.items() if k[0] in names} == want
        assert {k[0].rsplit(".", 1)[1] for k in got if k[0] not in names} <= {"USER_PREFERENCES", "ORDER_ITEMS", "CUSTOMER_ML_FEATURES"}


def test_rows_are_reached_along_the_keys(spark, linked):
    subj = people(spark, LIV)
    planned = X.plan_erasure(linked, subj, DAY, "s", honour_row_holds=False)
    assert not [n for n, e in planned.items() if e["status"] != "SUCCESS"]
    own = [r["order_id"] for r in linked["orders"].where(F.col("customer_email") == LIV).collect()]
    cust = [r["customer_id"] for r in linked["customers"].where(F.col("email") == LIV).collect()]
    left = planned["order_items"]["table"]
    assert own and left.where(F.col("order_id").isin(own)).count() == 0
    assert left.count() == linked["order_items"].where(~F.coalesce(F.col("order_id").isin(own), F.lit(False))).count()
    assert planned["user_preferences"]["table"].where(F.col("customer_id").isin(cust)).count() == 0
    features = planned["customer_ml_features"]["table"]
    assert features.count() == linked["customer_ml_features"].count()
    assert features.where(F.col("customer_id").isin(cust)).count() == 0
    changed = linked["customer_ml_features"].where(F.col("customer_id").isin(cust)).count()
    assert features.where(F.col("customer_id").startswith("PSEUDONYM_")).count() == changed > 0
    log = X.operation_log(planned, subj.withColumn("request_id", F.lit("R"))).collect()
    assert {"ORDER_ITEMS", "USER_PREFERENCES", "CUSTOMER_ML_FEATURES"} <= {r["target_table"] for r in log}


def test_items_of_held_orders_stay(spark, linked):
    planned = X.plan_erasure(linked, people(spark, LIV), DAY, "s")  # every fixture order is held
    assert planned["order_items"]["table"].count() == linked["order_items"].count()
    assert planned["order_items"]["affected"].count() == 0


class FailsWhileRunning(Linked):
    """Tickets and customers that can be planned, but not read to their end."""
    broken = "support_tickets"

    def __getitem__(self, name):
        df = super().__getitem__(name)
        if name != self.broken:
            return df
        c = "subject" if name == "support_tickets" else "city"
        return df.withColumn(c, F.when(F.length(c) >= 0, F.raise_error(F.lit("disk gone"))).otherwise(F.col(c)).cast("string"))


def test_a_table_that_fails_while_running_is_logged_without_a_state_too(spark, fixtures):
    subj = people(spark, "no.phone@mail.example", *[r["email"] for r in fixtures["customers"].collect()][-1:])
    planned = X.plan_erasure(FailsWhileRunning(spark), subj, DAY, "s", write=lambda n: scratch_path(spark, n))
    assert planned["support_tickets"]["status"] == "FAILED" and "disk gone" in planned["support_tickets"]["error"]
    assert planned["customers"]["status"] == "SUCCESS"


def test_children_of_a_table_that_failed_are_failed(spark):
    model = FailsWhileRunning(spark)
    model.broken = "customers"
    planned = X.plan_erasure(model, people(spark, LIV), DAY, "s", write=lambda n: scratch_path(spark, n))
    assert {n for n, e in planned.items() if e["status"] == "FAILED"} == {"customers", "user_preferences", "customer_ml_features"}


class Dies(Exception):
    pass


class DyingFolder(StateFolder):
    """Dies before its n-th change of the folder."""

    def __init__(self, spark, root, left):
        super().__init__(spark, root)
        self.left = left

    def _step(self):
        self.left -= 1
        if self.left < 0:
            raise Dies

    def _move(self, source, target):
        self._step()
        super()._move(source, target)

    def _delete(self, name):
        self._step()
        super()._delete(name)


def fill(state):
    """One run over two tables, one of them with a log part, and an addition."""
    spark = state.spark
    state.begin()
    marked = X.mark_rows(state.read("people"), people(spark, "a@x.example"), "DELETE", DAY)
    X.write_erased(marked, ["row_id", "customer_email"], "DELETE", "", ["customer_email"], state.next_path("people"))
    state.stage("requests", spark.createDataFrame([("done",)], "status string"))
    state.stage_append("log", spark.createDataFrame([("op",)], "id string"))
    state.commit(["people", "requests"])


def test_a_run_that_dies_anywhere_changes_all_or_nothing(spark):
    outcomes = set()
    for left in range(40):
        root = scratch_path(spark, "dies")
        fresh = StateFolder(spark, root)
        fresh.stage("people", spark.createDataFrame([(1, "a@x.example"), (2, "b@x.example")], "row_id long, customer_email string"))
        fresh.stage("requests", spark.createDataFrame([("open",)], "status string"))
        fresh.commit(["people", "requests"])
        try:
            fill(DyingFolder(spark, root, left))
            died = False
        except Dies:
            died = True
        again = StateFolder(spark, root)
        before = (sorted(r[0] for r in again.read("people").collect()), again.read("requests").first()[0], again.has("log"))
        assert before in (([1, 2], "open", False), ([2], "done", True))
        outcomes.add(before[1])
        fill(again)  # run again: nobody comes back, nothing is lost
        assert sorted(r[0] for r in again.read("people").collect()) == [2]
        assert again.read("requests").first()[0] == "done"
        assert again.read("log").count() == (2 if before[2] else 1)  # each run's own
        assert not again._exists("people/part_of=log")  # no copy of the erased rows stays
        if not died:
            break
    assert not died and outcomes == {"open", "done"}


def test_a_failed_rename_is_an_error(spark):
    state = StateFolder(spark, scratch_path(spark, "rename"))
    with pytest.raises(Exception):
        state._move("not/there", "some/where")


def test_the_same_batch_twice(spark, model):
    """On one day: new requests with new ids, and results that outlast later runs."""
    held = {r["customer_id"] for r in model["retention_policies"].collect()}
    busy = {r["customer_email"] for r in model["erasure_requests"].collect()}
    free = sorted(r["email"] for r in model["customers"].collect() if r["customer_id"] not in held and r["email"] not in busy)[:2]
    state = StateFolder(spark, scratch_path(spark, "twice"))
    first = full_scenario(model, people(spark, *free), AS_OF, "s", state=state)
    rows = first["rows_by_table"]["customers"]
    assert rows["rows_affected"] == 2 and rows["rows_written"] == model["customers"].count() - 2
    full_scenario(model, people(spark, *free), AS_OF, "s", state=state)
    for name, key, n in (("erasure_requests", "request_id", None), ("third_party_notifications", "notification_id", 20),
                         ("workflow_audit", "audit_id", 12)):
        ids = [r[key] for r in state.read(name).collect()]
        assert len(ids) == len(set(ids)) and n in (None, len(ids))
    assert state.read("erasure_requests").where(F.col("customer_email").isin(free)).count() == 4
    assert {r["deletion_completed"] for r in first["status_after"].collect()} == {True}
    assert not {r["email"] for r in state.read("customers").collect()} & set(free)


def test_independent_tables_are_written_side_by_side(spark, model, monkeypatch):
    """Two tables that name subjects themselves wait for each other here; one after the other they would time out."""
    import threading
    real, meet, lock, calls = X.write_erased, threading.Barrier(2, timeout=60), threading.Lock(), []

    def met(*args, **more):
        with lock:
            calls.append(args[5])
            first = len(calls) <= 2
        if first:
            meet.wait()
        return real(*args, **more)
    monkeypatch.setattr(X, "write_erased", met)
    subjects = model["customers"].where("customer_id IN ('CUST_3', 'CUST_5')").selectExpr("email AS customer_email")
    planned = X.plan_erasure(model, subjects, "2001-08-01", "s", write=lambda name: scratch_path(spark, f"t-{name}"))
    assert [n for n, e in planned.items() if e["status"] == "FAILED"] == [] and len(calls) == 8
    assert list(planned) == [t[0] for t in X.erasure_targets(model)]


def test_written_timestamps_are_long(spark, model):
    """Eight bytes with statistics, not the twelve of INT96."""
    import glob
    import pyarrow.parquet as pq
    from lethe.session import materialize, configure
    configure(spark)
    kept = materialize(model["orders"].select("order_date").limit(5), "t-stamps")
    file = glob.glob(kept.inputFiles()[0].removeprefix("file://"))[0]
    assert pq.ParquetFile(file).schema.column(0).physical_type == "INT64"

"""Erasures of kept tables that rewrite only the files holding a subject."""
import datetime as dt

import pytest

from lethe.plans import erasure as X
from lethe.session import scratch_path
from lethe.sources.state import StateFolder
from tests.test_erasure import Dies, DyingFolder

DAY = dt.date(2001, 8, 1)
SCHEMA = "row_id long, customer_email string, can_be_deleted boolean"
ROWS = [(i, f"u{i % 40:02d}@x.example" if i % 7 else None, i % 5 != 0) for i in range(400)]


def subjects(spark, *who):
    return spark.createDataFrame([(w,) for w in who], "customer_email string")


def kept(spark, name="t"):
    state = StateFolder(spark, scratch_path(spark, "rewrite"))
    state.stage(name, spark.createDataFrame(ROWS, SCHEMA).repartitionByRange(8, "customer_email"))
    state.commit([name])
    return state


def erase(state, *who, op="DELETE", commit=True):
    subj = subjects(state.spark, *who)
    done = X.rewrite_files(state, "t", lambda t: X.mark_rows(t, subj, op, DAY), subj, op, "s", ["customer_email"])
    if commit:
        state.commit()
    return done


def ids(df):
    return sorted(r["row_id"] for r in df.select("row_id").collect())


def left(*who):
    return sorted(i for i, e, free in ROWS if not (e in who and free))


def test_untouched_files_keep_their_names(spark):
    state = kept(spark)
    before = state.files("t")
    done = erase(state, "u03@x.example", commit=False)
    assert ids(done["table"]) == left("u03@x.example") and ids(state.read("t")) == [r[0] for r in ROWS]
    gone = [i for i, e, free in ROWS if e == "u03@x.example" and free]
    assert ids(done["log"].where("__hit")) == gone and done["rows"]["rows_affected"] == len(gone)
    state.commit()
    after = state.files("t")
    assert len(done["files"]) == 1 and set(before) - set(after) == set(done["files"])
    assert len(before) == 8 and all(f.startswith("run_id=") for f in set(after) - set(before))
    assert ids(state.read("t")) == left("u03@x.example")
    assert state.read("t").columns == ["row_id", "customer_email", "can_be_deleted"]


def test_again_and_again(spark):
    """Files written by an earlier erasure may be replaced too; nothing left of the old ones."""
    state = kept(spark)
    erase(state, "u03@x.example", "u39@x.example")
    erase(state, "u04@x.example", "u39@x.example")
    assert ids(state.read("t")) == left("u03@x.example", "u04@x.example", "u39@x.example")
    n = len(state.files("t"))
    assert erase(state, "nobody@x.example")["files"] == [] and len(state.files("t")) == n
    every = sorted({e for _, e, _ in ROWS if e})
    erase(state, *every)
    assert ids(state.read("t")) == left(*every)
    # a full rewrite later on replaces all of it
    state.stage("t", state.read("t").where("customer_email IS NULL"))
    state.commit(["t"])
    assert ids(state.read("t")) == sorted(i for i, e, _ in ROWS if e is None)


def test_pseudonyms_are_written_once(spark):
    state = kept(spark)
    erase(state, "u05@x.example", op="PSEUDONYMIZE")
    rows = {r["row_id"]: r["customer_email"] for r in state.read("t").collect()}
    assert sorted(rows) == [r[0] for r in ROWS]
    assert all(rows[i].startswith("PSEUDONYM_") if e == "u05@x.example" else rows[i] == e for i, e, _ in ROWS)
    assert erase(state, "u05@x.example", op="PSEUDONYMIZE")["files"] == []


def test_rows_reached_by_a_key(spark):
    state = kept(spark)
    owners = spark.createDataFrame([(3, ["a"]), (390, ["a", "b"])], "__key long, __subjects array<string>")
    done = X.rewrite_files(state, "t", lambda t: X.mark_by_key(t, "row_id", owners), subjects(spark, "a", "b"), "DELETE", "s", [], "row_id")
    state.commit()
    assert len(done["files"]) <= 2 and ids(state.read("t")) == [r[0] for r in ROWS if r[0] not in (3, 390)]


def test_a_table_of_which_nothing_is_left(spark):
    state = StateFolder(spark, scratch_path(spark, "rewrite"))
    state.stage("t", spark.createDataFrame([(1, "a@x.example", True)], SCHEMA))
    state.commit(["t"])
    erase(state, "a@x.example")
    assert state.read("t").count() == 0 and state.read("t").columns == ["row_id", "customer_email", "can_be_deleted"]
    assert erase(state, "a@x.example")["files"] == []


@pytest.mark.parametrize("left_steps", [0, 1, 2, 3, 4, 5, 6, 7])
def test_a_run_that_dies_changes_all_or_nothing(spark, left_steps):
    state = kept(spark)
    try:
        erase(DyingFolder(spark, state.root, left_steps), "u03@x.example")
    except Dies:
        pass
    again = StateFolder(spark, state.root)
    assert ids(again.read("t")) in ([r[0] for r in ROWS], left("u03@x.example"))
    again.begin()
    erase(again, "u03@x.example")
    assert ids(again.read("t")) == left("u03@x.example")
    assert not again._exists("__staged") and not again._exists("__commit")
    assert not any("part_of=log" in f for f in again.files("t"))


def test_a_folder_whose_path_has_odd_characters(spark):
    state = StateFolder(spark, scratch_path(spark, "a b+c%41"))
    state.stage("t", spark.createDataFrame(ROWS, SCHEMA).repartitionByRange(4, "customer_email"))
    state.commit(["t"])
    assert len(erase(state, "u03@x.example")["files"]) == 1 and ids(state.read("t")) == left("u03@x.example")

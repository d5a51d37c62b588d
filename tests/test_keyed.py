from lethe.operators.keyed import latest_per_key, not_in, pick_one_per_key


def test_not_in_null_rules(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "e string")
    empty = spark.createDataFrame([], "k string")
    assert not_in(df, "e", empty, "k").count() == 3  # empty set keeps NULL too
    s = spark.createDataFrame([("a",)], "k string")
    assert [r.e for r in not_in(df, "e", s, "k").collect()] == ["b"]  # NULL dropped
    s_null = spark.createDataFrame([("a",), (None,)], "k string")
    assert not_in(df, "e", s_null, "k").count() == 0  # NULL in the set drops all


def test_latest_per_key_keeps_ties(spark):
    df = spark.createDataFrame([("x", 1, "r1"), ("x", 2, "r2"), ("x", 2, "r3"), ("y", 5, "r4")],
                               "k string, t long, id string")
    got = sorted(r.id for r in latest_per_key(df, "k", "t").collect())
    assert got == ["r2", "r3", "r4"]


def test_pick_one_per_key_breaks_ties(spark):
    df = spark.createDataFrame([("x", 2, "r2"), ("x", 2, "r3"), ("x", 1, "r9")],
                               "k string, t long, id string")
    got = pick_one_per_key(df, "k", ["t", "id"], ["id", "t"]).collect()
    assert [(r.k, r.id) for r in got] == [("x", "r3")]


def test_tag_rows_both_strategies_agree(spark):
    from lethe.operators.subjects import count_matches, tag_rows
    df = spark.createDataFrame([("r1", "a@x"), ("r2", None), ("r3", "b@x"), ("r4", "a@x")],
                               "id string, e string")
    subj = spark.createDataFrame([("a@x",), (None,)], "customer_email string")
    small = sorted((r["id"], r["__subject"]) for r in tag_rows(df, subj, ["e"]).collect())
    big = sorted((r["id"], r["__subject"]) for r in tag_rows(df, subj, ["e"], max_rows=0).collect())
    assert small == big == [("r1", "a@x"), ("r2", None), ("r3", None), ("r4", "a@x")]
    c1 = count_matches(df, "e", subj, []).collect()
    c2 = count_matches(df, "e", subj, [], max_rows=0).collect()
    assert [(r.customer_email, r.records_found) for r in c1] == \
        [(r.customer_email, r.records_found) for r in c2] == [("a@x", 2)]


def test_not_in_shuffle_path_matches_broadcast_path(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "e string")
    for s_rows, want in [([("a",)], ["b", "c"]), ([("a",), (None,)], []), ([], ["a", "b", "c", None])]:
        s = spark.createDataFrame(s_rows, "k string")
        small = sorted(not_in(df, "e", s, "k").collect(), key=str)
        big = sorted(not_in(df, "e", s, "k", max_rows=0).collect(), key=str)
        assert small == big
        assert sorted((r.e for r in small), key=str) == sorted(want, key=str)

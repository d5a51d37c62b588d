"""Operators against brute-force Python on random inputs (hypothesis)."""
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lethe.operators.keyed import latest_per_key, not_in, pick_one_per_key
from lethe.operators.subjects import count_matches

keys = st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d"]))


@settings(max_examples=12, deadline=None)
@given(st.lists(keys, max_size=8), st.lists(keys, max_size=4), st.booleans())
def test_not_in_matches_sql_semantics(spark, left, right, small):
    df = spark.createDataFrame([(x,) for x in left], "e string")
    s = spark.createDataFrame([(x,) for x in right], "k string")
    got = sorted((r.e for r in not_in(df, "e", s, "k", max_rows=10 if small else 0).collect()),
                 key=str)
    if not right:
        want = left
    elif None in right:
        want = []
    else:
        want = [x for x in left if x is not None and x not in right]
    assert got == sorted(want, key=str)


rows = st.lists(st.tuples(keys, st.integers(0, 3), st.integers(0, 99)), max_size=10,
                unique_by=lambda r: r[2])


@settings(max_examples=12, deadline=None)
@given(rows)
def test_latest_per_key_keeps_all_ties(spark, data):
    df = spark.createDataFrame(data, "k string, t long, id long")
    got = sorted(r.id for r in latest_per_key(df, "k", "t").collect())
    best = {}
    for k, t, _ in data:
        if k is not None:
            best[k] = max(best.get(k, t), t)
    want = sorted(i for k, t, i in data if k is not None and t == best[k])
    assert got == want


@settings(max_examples=12, deadline=None)
@given(rows)
def test_pick_one_per_key_is_the_max_tuple(spark, data):
    df = spark.createDataFrame(data, "k string, t long, id long")
    got = {r.k: r.id for r in pick_one_per_key(df, "k", ["t", "id"], ["id", "t"]).collect()}
    want = {}
    for k, t, i in data:
        if k is not None and (k not in want or (t, i) > want[k]):
            want[k] = (t, i)
    assert got == {k: v[1] for k, v in want.items()}


@settings(max_examples=12, deadline=None)
@given(st.lists(keys, max_size=10), st.lists(keys, max_size=4), st.booleans())
def test_count_matches_both_paths(spark, values, subjects, small):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    s = spark.createDataFrame([(x,) for x in subjects], "customer_email string")
    got = {r.customer_email: r.records_found
           for r in count_matches(df, "v", s, [], max_rows=10 if small else 0).collect()}
    subj = {x for x in subjects if x is not None}
    want = Counter(v for v in values if v is not None and v in subj)
    assert got == dict(want)


def test_skewed_keys_same_answer_on_both_paths(spark, model):
    """A third of the rows share one e-mail and a third have none: the
    broadcast and shuffle strategies (NULL keys spread, AQE skew handling)
    return the same rows."""
    from pyspark.sql import functions as F
    from lethe.plans import erasure as X
    acts = model["user_activities"]
    k = F.substring("event_id", 5, 20).cast("long")
    hot = "hot.subject@example.com"
    skewed = acts.withColumn("user_email", F.when(k % 3 == 0, F.lit(hot))
                             .when(k % 3 == 1, F.lit(None)).otherwise(F.col("user_email")))
    subj = spark.createDataFrame([(hot,), ("user7@building.example.com",)], "customer_email string")
    a = X.tag_rows(skewed, subj, max_broadcast_rows=10).where("__subject IS NOT NULL")
    b = X.tag_rows(skewed, subj, max_broadcast_rows=0).where("__subject IS NOT NULL")
    assert a.count() == b.count() == skewed.where(F.col("user_email").isin(
        hot, "user7@building.example.com")).count()
    assert not_in(skewed, "user_email", subj, "customer_email", max_rows=0).count() == \
        not_in(skewed, "user_email", subj, "customer_email").count()


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(keys, st.one_of(st.none(), st.integers(0, 2)), st.integers(0, 99)),
                max_size=8, unique_by=lambda r: r[2]))
def test_latest_request_join_is_a_left_join_with_ties(spark, reqs):
    from lethe.plans.views import latest_request_join
    cust = spark.createDataFrame([("C1", "a"), ("C2", "b"), ("C3", "c"), ("C4", None)],
                                 "customer_id string, email string")
    r = spark.createDataFrame([(e, "S", t, None, i) for e, t, i in reqs],
                              "customer_email string, status string, requested_at long, "
                              "completed_at long, rid long")
    got = [(x.customer_id, x.requested_at) for x in latest_request_join(cust, r).collect()]
    best = {}
    for e, t, _ in reqs:
        if e is not None and t is not None:
            best[e] = max(best.get(e, t), t)
    want = []
    for cid, em in [("C1", "a"), ("C2", "b"), ("C3", "c"), ("C4", None)]:
        hits = [t for e, t, _ in reqs if em is not None and e == em and t is not None and t == best.get(e)]
        want += [(cid, t) for t in hits] or [(cid, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_salted_join_equals_plain_join_on_skewed_keys(spark, model):
    from pyspark.sql import functions as F
    from lethe.operators.skew import salted_join
    acts = model["user_activities"].select("event_id", "user_email")
    k = F.substring("event_id", 5, 20).cast("long")
    hot = "hot.subject@example.com"
    big = acts.withColumn("user_email", F.when(k % 3 == 0, F.lit(hot))
                          .when(k % 3 == 1, F.lit(None)).otherwise(F.col("user_email")))
    small = (model["erasure_requests"].select(F.col("customer_email").alias("s")).distinct()
             .unionByName(spark.createDataFrame([(hot,)], "s string")))
    for how in ("left", "inner", "left_anti"):
        salted = salted_join(big, small, "user_email", "s", how, buckets=4, broadcast_max_rows=None)
        plain = big.join(small, big["user_email"] == small["s"], how)
        cols = ["event_id", "user_email"] + ([] if how == "left_anti" else ["s"])
        assert sorted(map(tuple, salted.select(*cols).collect()), key=str) == \
            sorted(map(tuple, plain.select(*cols).collect()), key=str), how
    p = salted_join(big, small, "user_email", "s", "left", buckets=4, broadcast_max_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in p


def test_only_hot_keys_are_salted(spark):
    """Of a table without a hot key nothing is repeated; with one, its rows alone are, and joins stay exact."""
    from pyspark.sql import functions as F
    from lethe.operators.skew import hot_keys, salted_join
    big = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('u', id % 50) END AS e", "id")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("u1", 3), ("u1", 4), ("u2", 5), (None, 6), ("none", 7)], "k string, v int")
    assert [r[0] for r in hot_keys(big, "e", 500).collect()] == ["hot"] and hot_keys(big, "e").count() == 0
    for how in ("inner", "left", "left_anti"):
        plain = big.join(small, big["e"] == small["k"], how)
        for hot_rows in (500, 10, 10_000):
            got = salted_join(big, small, "e", "k", how, buckets=4, hot_rows=hot_rows)
            assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())), (how, hot_rows)
    own = big.groupBy("e").agg(F.count(F.lit(1)).alias("n"))  # the small side comes from the same table
    assert salted_join(big, own.withColumnRenamed("e", "k"), "e", "k", "inner", hot_rows=500).count() == big.where("e IS NOT NULL").count()

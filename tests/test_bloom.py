"""The Bloom filter before shuffle joins: no match is lost, few others pass."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lethe.operators.bloom import build, maybe_in
from lethe.operators.skew import salted_join
from lethe.operators.subjects import count_matches, tag_rows


@pytest.mark.parametrize("n_keys", [0, 1, 17, 20_000])
def test_no_key_is_lost_and_few_others_pass(spark, n_keys):
    keys = spark.range(n_keys).selectExpr("concat('u', id, '@x.org') AS k")
    keys = keys.union(keys).union(spark.createDataFrame([(None,)], "k string"))
    rows = spark.range(60_000).selectExpr("CASE WHEN id % 7 = 0 THEN NULL ELSE concat('u', id, '@x.org') END AS e", "id")
    got = maybe_in(rows, "e", build(keys, "k"))
    assert got.columns == ["e", "id"]
    want = [i for i in range(n_keys) if i % 7]
    ids = {r.id for r in got.collect()}
    assert ids >= set(want) and not {i for i in ids if i % 7 == 0}
    assert len(ids) - len(want) <= 0.02 * 60_000


def test_random_keys_of_any_characters(spark):
    rng = np.random.default_rng(11)
    alphabet = np.array(list("aZ9@. é世\U0001f600\n\\\"%"))
    words = ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(0, 9, 3000)]
    keys = sorted(set(words[:400]))
    df = spark.createDataFrame([(w,) for w in words], "e string")
    passed = {r.e for r in maybe_in(df, "e", build(spark.createDataFrame([(k,) for k in keys], "k string"), "k")).collect()}
    assert passed >= set(keys)


def test_a_crowded_filter_loses_nothing_and_a_too_large_set_has_none(spark):
    keys = spark.range(300).selectExpr("concat('u', id) AS k")
    rows = spark.range(5000).selectExpr("concat('u', id) AS e")
    crowded = build(keys, "k", max_blocks=5)
    assert crowded.n_blocks == 5
    assert maybe_in(rows, "e", crowded).where("CAST(substr(e, 2) AS INT) < 300").count() == 300
    assert build(keys, "k", max_blocks=4) is None
    assert maybe_in(rows, "e", None) is rows


def test_joins_agree_with_and_without(spark):
    big = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 5 = 0 THEN NULL ELSE concat('u', id) END AS e", "id")
    small = spark.createDataFrame([("hot",), ("u1",), ("u2",), ("none",)], "k string")
    for how in ("inner", "left", "left_anti"):
        plain = salted_join(big, small, "e", "k", how)
        assert sorted(map(str, plain.collect())) == sorted(map(str, salted_join(big, small, "e", "k", how, bloom=build(small, "k")).collect()))
    subjects = small.withColumnRenamed("k", "customer_email")
    few, many = (tag_rows(big, subjects, ["e"], max_rows=n) for n in (1_000_000, 0))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    few, many = (count_matches(big, "e", subjects, [], max_rows=n).collect() for n in (1_000_000, 0))
    assert sorted(few) == sorted(many)


def test_less_enters_the_shuffle(spark):
    values = spark.range(50_000).selectExpr("concat('u', id) AS e")
    subjects = spark.range(2000).selectExpr("concat('u', id * 100) AS customer_email")
    plan = count_matches(values, "e", subjects, [], max_rows=0)
    assert plan.count() == 500
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "LeftSemi" in text and "NestedLoop" not in text
    kept = maybe_in(values, "e", build(subjects, "customer_email"))
    assert 500 <= kept.agg(F.count(F.lit(1))).first()[0] <= 1500  # of 50,000

"""Erasures that arrive as a stream: batches in turn against brute force, reruns, state, late rows."""
import datetime as dt
import random

import pytest

from lethe.session import scratch_path
from lethe.streaming.erasures import LiveSuppression, suppress_live, with_erasures

DAY = dt.timedelta(days=1)
T0 = dt.datetime(1969, 12, 25)  # times on both sides of 1970
ROWS = "id long, micro_batch string, email string, ts timestamp"
DONE = "who string, done_at timestamp"


def job(spark, keep=3 * DAY, delay=DAY):
    return LiveSuppression(spark, scratch_path(spark, "t-live"), spark.createDataFrame([], ROWS).schema, keep, delay)


def batch(spark, rows, done):
    return with_erasures(spark.createDataFrame(rows, ROWS), "email", "ts", spark.createDataFrame(done, DONE), "who", "done_at")


def brute(batches, keep, delay):
    seen, newest, kept, late = [], None, [], []
    for rows, done in batches:
        seen += [d for d in done if None not in d]
        for i, _, who, ts in rows:
            if ts is None or newest is not None and ts < newest - delay:
                late.append(i)
            elif not any(w == who and at <= ts < at + keep for w, at in seen):
                kept.append(i)
        times = [r[3] for r in rows if r[3]] + [d[1] for d in done if d[1]] + ([newest] if newest else [])
        newest = max(times, default=None)
    return sorted(kept), sorted(late)


def made_batches(seed, n=6):
    rng, out, i = random.Random(seed), [], 0
    for b in range(n):
        rows, done = [], []
        for _ in range(60):
            who = rng.choice(["hot@x.example"] * 4 + ["a@x.example", "b@x.example", None])
            ts = T0 + b * 2 * DAY + dt.timedelta(minutes=rng.randrange(-3000, 3000)) if rng.random() > 0.05 else None
            rows.append((i, "row's own", who, ts))
            i += 1
        for _ in range(rng.randrange(4)):
            done.append((rng.choice(["hot@x.example", "a@x.example", None]), T0 + b * 2 * DAY + dt.timedelta(minutes=rng.randrange(-3000, 3000))))
        out.append((rows, done))
    return out


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_turn_equal_brute_force_and_may_run_again(spark, seed):
    batches, live = made_batches(seed), job(spark)
    for n, (rows, done) in enumerate(batches):
        for _ in range(2 if n in (0, 3) else 1):
            live.step(batch(spark, rows, done), n)
    kept, late = brute(batches, 3 * DAY, DAY)
    assert ids(live.read("kept")) == kept and ids(live.read("late")) == late
    assert live.read("kept").columns == ["id", "micro_batch", "email", "ts"]
    assert late and len(kept) < 360 - len(late)


def test_large_state_takes_the_salted_join(spark, monkeypatch):
    from lethe.streaming import erasures
    monkeypatch.setattr(erasures, "is_small", lambda df: False)
    batches, live = made_batches(3, 2), job(spark)
    for n, (rows, done) in enumerate(batches):
        live.step(batch(spark, rows, done), n)
    kept, late = brute(batches, 3 * DAY, DAY)
    assert ids(live.read("kept")) == kept and ids(live.read("late")) == late


def test_state_is_bounded(spark):
    """Many erasures of a subject are one row of state; spans that ended are dropped."""
    live = job(spark)
    done = [("hot@x.example", T0 + dt.timedelta(seconds=s)) for s in range(5000)]
    live.step(batch(spark, [], done), 0)
    assert live.state(0).count() <= 2
    live.step(batch(spark, [(1, "", "z@x.example", T0 + 30 * DAY)], []), 1)
    assert live.state(1).count() == 0


def test_no_batches_and_empty_batches(spark):
    live = job(spark)
    assert live.read("kept").count() == 0 and live.read("late").columns == ["id", "micro_batch", "email", "ts"]
    live.step(batch(spark, [], []), 0)
    live.step(batch(spark, [(1, "", "a@x.example", T0)], [("a@x.example", None)]), 1)
    assert ids(live.read("kept")) == [1]
    with pytest.raises(ValueError):
        job(spark, keep=dt.timedelta(0))


def test_two_file_streams(spark):
    """Rows after the erasure vanish in later micro-batches too, up to the end of ``keep``."""
    root = scratch_path(spark, "t-two-streams")
    rows = [(d, "", "a@x.example", T0 + d * DAY) for d in range(12)] + [(100 + d, "", "b@x.example", T0 + d * DAY) for d in range(12)]
    for d in range(0, 12, 4):
        spark.createDataFrame([r for r in rows if d <= r[0] % 100 < d + 4], ROWS).coalesce(1).write.mode("append").parquet(f"{root}/rows")
    spark.createDataFrame([("a@x.example", T0 + 2 * DAY)], DONE).coalesce(1).write.parquet(f"{root}/done")

    def stream(name, schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/{name}")
    kept, late = suppress_live(stream("rows", ROWS), "email", "ts", stream("done", DONE), "who", "done_at", 5 * DAY, 20 * DAY)
    assert ids(kept) == [0, 1, 7, 8, 9, 10, 11] + list(range(100, 112)) and late.count() == 0

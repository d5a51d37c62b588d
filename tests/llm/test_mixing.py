import hashlib
import math
import re

import pytest

from lethe.llm import mixing
from lethe.llm.common import pick
from tests.llm.conftest import rows_of


def shared(sizes):
    """Targets by sharing again and again: {source: (size, target)}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: (sizes[s], share.get(s, 3 * sizes[s])) for s in order}
        capped |= over


def brute(rows):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    targets = shared(sizes)
    out = []
    for i, t, _, s in rows:
        size, target = targets[s]
        rate = target / size if size else 0.0
        u = int(hashlib.md5(f"{'null' if i is None else i}:{mixing.SEED}".encode()).hexdigest()[:13], 16) / 2 ** 52
        out.append((i, count(t), size, target, count(t) * (math.floor(rate) + (u < rate - math.floor(rate)))))
    return out


def test_against_sharing_by_rounds(make_docs):
    rows = [(i, "w " * (i % 40) + "é x", "en", f"s{i % 5}") for i in range(200)]
    rows += [(1000 + i, "tiny", "en", "aaa") for i in range(2)] + [(1100, "a\x0bb\x0cc d", "en", None), (None, None, None, None),
                                                                  (5, "again", "en", "s1"), (5, "again", "en", "s1"), (1200, "", "en", "zero")]
    docs = make_docs(rows)
    got = rows_of(mixing.op5_mixing(docs), "doc_id", "size", "source_size", "target", "taken")
    want = sorted(brute(rows), key=lambda r: tuple((x is None, x) for x in r))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    emitted = mixing.mix(docs)
    assert emitted.columns == docs.columns
    from collections import Counter
    times = Counter(rows_of(pick(emitted, "text", "doc_id", "source").filter("text is not null").select("doc_id", "source")))
    want_times = Counter()
    for (i, _, _, s), (_, size, _, _, taken) in zip(rows, brute(rows)):
        if size:
            want_times[i, s] += taken // size
    assert {k: v for k, v in times.items()} == {k: v for k, v in want_times.items() if v}


def test_nothing(make_docs):
    assert rows_of(mixing.op5_mixing(make_docs([]))) == []
    assert rows_of(mixing.op5_mixing(make_docs([(1, None, None, None), (2, " \t", "en", "a")])), "doc_id", "taken") == [(1, 0), (2, 0)]
    assert mixing.mix(make_docs([(1, "", "en", "a")])).count() == 0


def test_many_sources_never_meet_in_one_task(spark):
    sizes = {f"host{i:04d}": i * 37 % 900 for i in range(3000)} | {"": 5}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = mixing.rates(spark.createDataFrame([(False, s, n) for s, n in sizes.items()], "src_null boolean, src string, size long"))
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
        got = {r["src"]: (r["source_size"], r["target"]) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = shared(sizes)
    assert {s: n for s, (n, _) in got.items()} == sizes
    assert [got[s][1] for s in sizes] == pytest.approx([want[s][1] for s in sizes])


def test_rates_of_no_source(spark):
    assert mixing.rates(spark.createDataFrame([], "src_null boolean, src string, size long")).collect() == []

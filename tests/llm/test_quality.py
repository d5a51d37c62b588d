import zlib

import numpy as np
import pytest

from lethe.llm import quality
from lethe.llm.quality import DEPTH, Trees, grow, statistics


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_flattened_trees_equal_walking_them():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    t = grow(x, y)

    def walk(row):
        total = t.base
        for f, cut, leaf in zip(t.feature, t.threshold, t.leaf):
            node = 0
            while node < 2 ** DEPTH - 1:
                node = 2 * node + (2 if row[f[node]] > cut[node] else 1)
            total += leaf[node - (2 ** DEPTH - 1)]
        return 1 / (1 + np.exp(-total))
    assert t.score(x) == pytest.approx([walk(r) for r in x])
    assert ((t.score(x) >= 0.5) == y).mean() > 0.95


def test_constant_without_two_labels():
    assert len(grow(np.zeros((0, 3)), np.zeros(0)).feature) == 0
    assert isinstance(grow(np.ones((4, 3)), np.ones(4)), Trees)
    assert (grow(np.ones((4, 3)), np.ones(4)).score(np.ones((2, 3))) > 0.5).all()


def test_statistics_of_any_text():
    for t in (None, "", " ", "\n\n", "a", "é" * 10, "x" * 300_000, "a b " * 50_000):
        s = statistics(t)
        assert len(s) == len(quality.STATISTICS) and np.isfinite(s).all()
    assert statistics(None) == statistics("")


def test_scores(spark, make_docs):
    good = "The quiet river ran past the old mill and nobody minded the number {}."
    bad = "BUY!!! NOW!!! ### {} $$$ | | |"
    rows = [(i, (good if i % 2 else bad).format(i) * 3) for i in range(400)] + [(5000, None), (5001, ""), (None, good), (7, good), (7, good)]
    labels = [(i, i % 2, 0) for i in range(400)] + [(3, None, 0), (None, 1, 0), (7, 1, 0), (9999, 0, 0)]
    ls = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score(make_docs(rows), ls).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    out = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert out and all(r["predicted"] == r["doc_id"] % 2 for r in out)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert quality.score(make_docs([]), ls).collect() == []
    blank = quality.score(make_docs([(1, "a"), (2, None)]), ls.limit(0)).collect()
    assert len({r["score"] for r in blank}) == 1

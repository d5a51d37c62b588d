import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lethe.llm import simhash_dedup as S
from lethe.llm.graph import components
from tests.llm.conftest import rows_of


def by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "A b", "a B c", "É A b\x0bc d\x1ce", "x y z x y z x y z", "w " * 70_000])
def test_fingerprint(text):
    assert S.fingerprint(text) % 2 ** 64 == by_definition(text)


def brute(fps, radius, apart=None):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    if apart is not None:
        near &= apart[:, None] != apart[None, :]
        near |= np.eye(len(fps), dtype=bool)
    labels = np.arange(len(fps))
    while True:
        new = np.array([labels[row].min() for row in near])
        if (new == labels).all():
            return labels
        labels = new


def clusters(rng, n):
    centres = rng.integers(0, 2 ** 64, max(1, n // 20), dtype=np.uint64)
    fps = centres[rng.integers(0, len(centres), n)].copy()
    for i in range(n):
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            fps[i] ^= np.uint64(1) << np.uint64(b)
    return fps


@pytest.mark.parametrize("n,radius", [(2, 3), (63, 3), (64, 3), (65, 3), (500, 3), (300, 0), (300, 1), (300, 2), (300, 5)])
def test_bit_sliced_comparison(n, radius):
    fps = clusters(np.random.default_rng(n + radius), n)
    a, b = S.links(fps, np.zeros(n, bool), np.array([0]), radius)
    assert len(a) < n
    assert (S.join_labels(np.arange(n), a, b) == brute(fps, radius)).all()
    cut = np.array([0, n // 2])
    labels = S.join_labels(np.arange(n), *S.links(fps, np.zeros(n, bool), cut, radius))
    assert (labels[:n // 2] == brute(fps[:n // 2], radius)).all()
    side = np.arange(n) >= n // 2
    labels = S.join_labels(np.arange(n), *S.links(fps, side, np.array([0]), radius))
    assert (labels == brute(fps, radius, side)).all()


def test_masks_leave_no_pair_out():
    for ranges in (4, 5, 6):
        masks = [m % 2 ** 64 for m in S.masks(ranges, 3)]
        for bits in ((), (0,), (63, 0), (15, 16, 47), (1, 30, 62), (20, 21, 22)):
            x = sum(1 << b for b in bits)
            assert any(not x & m for m in masks)
    assert S.ranges_for(10, 3) == 4 < S.ranges_for(10 ** 9, 3)


def test_near_links_with_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 16)
    fps = np.unique(clusters(np.random.default_rng(5), 400) & np.uint64(0xFFFF0000FFFFFFFF))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = dict(rows_of(components(S.near_links(df))))
    want = brute(fps, 3)
    signed = fps.view(np.int64)
    for k in set(want):
        members = signed[want == k].tolist()
        assert {got.get(m, m) for m in members} == {min(members)}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 300)] + [(-5, 7)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"))))
    assert {got[i] for i in range(1, 61)} == {-5} and {got[i] for i in range(100, 400)} == {100}
    assert rows_of(components(spark.createDataFrame([], "a long, b long"))) == []


def test_documents(make_docs):
    base = "the quick brown fox jumps over the lazy dog again and again near the old river bank while nobody looks at it twice"
    rows = [(9, base), (4, base + " today"), (8, base.upper()), (1, None), (2, ""), (3, " "), (20, "entirely other words stand here"),
            (20, base), (20, base), (None, "no id at all"), (30, "w " * 50_000)]
    got = rows_of(S.op3_simhash_dedup(make_docs(rows)), "doc_id", "fingerprint", "component_id")
    fps = np.array([by_definition(t) for _, t in rows], np.uint64)
    labels = brute(fps, 3)
    want = []
    for (i, _), f, k in zip(rows, fps, labels):
        ids = [rows[j][0] for j in np.flatnonzero(labels == k) if rows[j][0] is not None]
        want.append((i, f"{int(f):016x}", min(ids, default=None)))
    assert got == sorted(want, key=lambda r: tuple((x is None, x) for x in r))


def test_keep_first(make_docs):
    base = "one two three four five six seven eight nine ten eleven twelve"
    docs = make_docs([(5, base), (3, base), (3, base), (3, "something else entirely stands in this row"), (7, None), (6, ""), (None, "lonely words")])
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    texts = defaultdict(list)
    for r in kept.collect():
        texts[r["doc_id"]].append(r[1])
    assert {k: sorted(map(str, v)) for k, v in texts.items()} == {
        3: [base, "something else entirely stands in this row"], 6: [""], None: ["lonely words"]}
    assert S.keep_first(make_docs([])).count() == 0


def test_memory_of_dense_groups():
    """Several groups of near copies in one batch, every lane of which is a link."""
    import tracemalloc

    import numpy as np
    rng = np.random.default_rng(4)
    groups = [np.uint64(int(rng.integers(0, 2 ** 63))) ^ np.array(
        [sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 2))) for _ in range(2048)], np.uint64) for _ in range(6)]
    fps = np.concatenate(groups)
    starts = np.arange(6) * 2048
    tracemalloc.start()
    a, b = S.links(fps, np.zeros(len(fps), bool), starts, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == 6 * 2047 and peak < 200 << 20

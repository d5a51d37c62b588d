import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lethe.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) by the formula, over all documents."""
    found = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    found = [(i, w, Counter(w)) for i, w in found if w]
    n_docs, n_terms = len(found), sum(len(w) for _, w, _ in found)
    df = Counter(t for _, _, c in found for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, w, c in found:
            m = 100 - 75 + (75 * len(w) * n_docs) // n_terms
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, n in asked.items() if c[t])
            if s:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def collected(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@given(st.integers(0, 2 ** 32), st.integers(1, 12), st.integers(1, 40))
@settings(max_examples=400, deadline=None)
def test_intervals_end_in_the_plain_ranking(seed, k, n_docs):
    """Many ties: few different counts, equal lengths; reading starts with one entry."""
    r = np.random.default_rng(seed)
    n = int(r.integers(0, 200))
    pairs = np.unique(np.stack([r.integers(0, n_docs, n), r.integers(0, 6, n)]), axis=1)
    doc, term = pairs
    tf = r.integers(1, 3, len(doc))
    m, weights = r.integers(90, 92, n_docs), r.integers(0, 3, 6)
    ids = r.permutation(n_docs) // 2
    shard = lexical.Shard(ids, m, doc, term, tf, weights)
    asked = [(int(t), int(c)) for t, c in zip(r.permutation(6)[:r.integers(1, 7)], r.integers(1, 4, 6))]
    score = Counter()
    for d, t, f in zip(doc, term, tf):
        score[d] += dict(asked).get(int(t), 0) * int(weights[t]) * (10 ** 9 * int(f) // (1000 * int(f) + 8 * int(m[d])))
    old, lexical.FIRST_STEP = lexical.FIRST_STEP, 1
    try:
        everyone = sorted((-s, ids[d]) for d, s in score.items() if s > 0)
        assert [(s, ids[d]) for s, d in shard.best(asked, k, 1)] == everyone[:k]
        reach = -everyone[len(everyone) // 2][0] if everyone else 1
        got = [(s, ids[d]) for s, d in shard.best(asked, k, reach)]
        assert got[:len(everyone)] == [x for x in everyone if -x[0] >= reach][:k]
    finally:
        lexical.FIRST_STEP = old


@pytest.fixture(params=[(1 << 21, 4 << 20), (60, 100)], ids=["whole", "small shards and blocks"])
def bounds(request, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_ENTRIES", request.param[0])
    monkeypatch.setattr(lexical, "BLOCK_BYTES", request.param[1])


def test_ranking_equals_brute_force(spark, make_docs, bounds):
    r = random.Random(5)
    words = ["the", "The", "of", "ciónñ", "a1", "7", "über", "x", "梦", "rare", "zz"]
    docs = [(i, " ".join(r.choices(words, [9, 3, 7, 3, 2, 2, 2, 4, 1, 1, 1], k=r.randrange(0, 40)))) for i in range(300)]
    docs += [(300 + i, "the of the of") for i in range(40)]  # ties
    docs += [(5, "rare words twice"), (5, "rare words twice"), (None, "rare x rare"), (400, None), (401, ""), (402, "-- ??"),
             (403, "the\x00of,x " * 4000)]
    items = [(1, "the rare x rare"), (2, "over the zz of THE of"), (3, None), (4, ""), (5, "unseen words only"), (1, "the rare x rare"),
             (2, "über-über 梦"), (None, "7 a1"), (6, "unheard")]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS q", "1 AS block", "2L AS ITEM_ID2")
    got = collected(lexical.search(make_docs(docs), table))
    assert got == sorted(brute(docs, items), key=repr)


def test_empty_tables(spark, make_docs):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert collected(lexical.search(make_docs([(1, "the")]).limit(0), items)) == []
    assert collected(lexical.search(make_docs([(1, "the")]), items.limit(0))) == []
    assert collected(lexical.search(make_docs([(1, None)]), items)) == []

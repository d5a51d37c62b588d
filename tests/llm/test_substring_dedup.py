import hashlib
import random

import numpy as np
import pytest

from lethe.llm import substring_dedup as S
from tests.llm.conftest import rows_of


def brute(docs):
    """doc -> (words, removed, digest); docs in (doc_id, start) order of earliness."""
    first = {}
    for i, t in docs:
        w = (t or "").encode().split()
        for s in range(len(w) - 19):
            k = tuple(w[s:s + 20])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = {}
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s:s + 20])] < (i, s):
                gone[s:s + 20] = [True] * 20
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cde f gh ijk lm é çx nop q".split()) + str(rng.randrange(3))
    passages = [" ".join(word() for _ in range(rng.choice([19, 20, 21, 35, 60]))) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(5)):
            kind = rng.randrange(6)
            if kind < 2:
                parts.append(rng.choice(passages))
            elif kind == 2:
                parts.append(" ".join(["a"] * rng.randrange(60)))
            elif kind == 3:
                period = [word() for _ in range(rng.randrange(1, 25))]
                parts.append(" ".join(period * rng.randrange(1, 6)))
            elif kind == 4 and docs:
                parts.append(rng.choice(docs)[1])
            else:
                parts.append("\n".join(word() for _ in range(rng.randrange(50))))
        docs.append((rng.randrange(10 ** 6) * 200 + i, "  ".join(parts)))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_windows(make_docs, seed):
    docs = corpus(seed)
    got = {r[0]: r[1:] for r in rows_of(S.op7_substring_dedup(make_docs(docs)), "doc_id", "n_words", "n_removed", "kept_sha256")}
    want = brute(docs)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_defined_cases(make_docs):
    p = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"x{i % 70_001}" for i in range(150_000))
    rows = [(1, p), (2, None), (3, ""), (4, "few words"), (5, p + " tail"), (None, p), (7, p), (7, p), (8, p), (8, "other " * 19 + p), (9, long)]
    got = rows_of(S.op7_substring_dedup(make_docs(rows)), "doc_id", "n_words", "n_removed")
    assert len(got) == len(rows)
    by = {}
    for i, n, gone in got:
        by.setdefault(i, []).append((n, gone))
    assert by[None] == [(30, 0)]  # a null doc_id comes first
    assert by[1] == [(30, 30)] and by[2] == by[3] == [(0, 0)] and by[4] == [(2, 0)] and by[5] == [(31, 30)]
    assert by[7] == [(30, 30)] * 2 and sorted(by[8]) == [(30, 30), (49, 30)]
    assert by[9] == [(150_000, 150_000 - 70_001)]
    assert S.op7_substring_dedup(make_docs([])).collect() == []


def test_spans_name_their_source(make_docs):
    p = " ".join(f"w{i}" for i in range(40))
    spans = S.repeated_spans(S._keyed(make_docs([(1, "a b c " + p), (2, p + " z"), (3, "y " + p)]))[0])
    assert rows_of(spans, "doc", "start", "windows", "src_doc", "src_pos") == [(2, 0, 21, 1, 3), (3, 1, 21, 1, 3)]


def test_a_false_repeat_is_not_removed(make_docs, monkeypatch):
    """Equal hashes over different words fail at the source coordinates."""
    monkeypatch.setattr(S, "_digest", lambda words, start, windows: hash((start, len(words))))
    p = " ".join(f"w{i}" for i in range(40))
    got = rows_of(S.op7_substring_dedup(make_docs([(1, "a b c " + p), (2, p + " z")])), "doc_id", "n_removed")
    assert got == [(1, 0), (2, 0)]


def test_word_hashes_cut_long_texts_at_white_space():
    h = S.Hasher()
    raw = b" ".join(b"word%d" % (i % 1000) for i in range(400_000))
    hashes, first = h.word_hashes(raw)
    assert len(hashes) == 400_000 and len(set(hashes.tolist())) == 1000 and (hashes[:1000] == hashes[399_000:]).all()
    one, _ = h.word_hashes(b"  " + b"q" * (3 << 20) + b"\x0b r")
    assert len(one) == 2 and len(np.unique(first)) == len(first)

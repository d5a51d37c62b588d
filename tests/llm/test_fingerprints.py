import hashlib
from collections import defaultdict

import numpy as np

from lethe.llm import fingerprints as P
from tests.llm.conftest import rows_of

TEXT = "the quick brown fox jumps over the lazy dog while {} birds look on from the old tree by the river and say nothing"


def test_documents(make_docs):
    rows = [(i * 3, TEXT.format(i) * (1 + i % 3)) for i in range(40)]
    rows += [(1, None), (2, ""), (4, "é"), (None, "first of all"), (500, "same"), (500, "same"), (500, "another"), (1000, "z" * 100_000)]
    got = P.op6_fingerprints(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    order = sorted({i for i, _ in rows if i is not None})
    texts = {i: t or "" for i, t in rows}
    for a, b in zip(order, order[1:]):
        if 500 in (a, b):
            continue
        (r,), k = by[a], len(texts[a]) // 4
        edited = texts[a][:len(texts[a]) - k] + texts[b][:k]
        assert r["n_chars"] == len(texts[a]) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    (last,) = by[1000]
    assert last["edited_sha256"] == hashlib.sha256(("z" * 75_000 + "first of all").encode()).hexdigest()
    maker = P.Fingerprinter()
    fps = {i: [int(r["fingerprint"], 16) for r in rs] for i, rs in by.items()}
    for i, t in rows:
        assert int(P.text_of(maker.fingerprint(t or "")), 16) in fps[i]
    flat = [f for fs in fps.values() for f in fs]
    for i, rs in by.items():
        for r in rs:
            f = int(r["fingerprint"], 16)
            assert r["n_near"] == sum((f ^ g).bit_count() <= P.RADIUS for g in flat) - 1
            assert 0 <= r["near_edited"] <= 1 and r["near_edited"] == 1 - (f ^ int(r["edited_fingerprint"], 16)).bit_count() / P.BITS
    assert P.op6_fingerprints(make_docs([])).collect() == []


def test_a_single_document_is_its_own_next(make_docs):
    (r,) = P.op6_fingerprints(make_docs([(5, "abcdefgh")])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1.0


def test_block_tables_find_every_near_pair(spark, monkeypatch):
    monkeypatch.setattr(P, "PART", 16)
    rng = np.random.default_rng(2)
    base = [int.from_bytes(rng.bytes(16), "little") for _ in range(6)]
    fps = set()
    for b in base:
        for _ in range(60):
            x = b
            for bit in rng.integers(0, 128, rng.integers(0, 7)):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = lambda x: x - 2 ** 64 if x >> 63 else x
    rows = [(signed(x % 2 ** 64), signed(x >> 64), 1 + x % 3) for x in fps]
    got = {(a, b): n for a, b, n in rows_of(P.count_near(spark.createDataFrame(rows, "fp_low long, fp_high long, docs long")))}
    for x in fps:
        want = sum(1 + y % 3 for y in fps if y != x and (x ^ y).bit_count() <= P.RADIUS)
        assert got.get((signed(x % 2 ** 64), signed(x >> 64)), 0) == want


def test_edits_stay_nearer_than_other_texts():
    maker = P.Fingerprinter()
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    for n in (1, 3, 12, 40, 400):
        a, b = (" ".join(rng.choice(words, n)) for _ in range(2))
        f = maker.fingerprint(a)
        assert P.likeness(f, maker.fingerprint(P.edit(a, b))) > P.likeness(f, maker.fingerprint(b))
    assert P.edit("abcd", "x") == "abcx" and P.edit("abc", "xyz") == "abc" and P.edit("abcdefgh", "x") == "abcdefx"

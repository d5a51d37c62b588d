import heapq
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lethe.llm import sharding
from tests.llm.conftest import rows_of


def one_by_one(sizes, n):
    heap = [(0, s) for s in range(n)]
    for size, count in sorted(sizes, reverse=True):
        for _ in range(count):
            load, s = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, s))
    return sorted(load for load, _ in heap)


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), max_size=12), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_schedule_has_the_loads_of_the_heap(sizes, n):
    load = [0] * n
    for size, takers, ends in sharding.schedule(list(sizes.items()), n):
        for s, a, b in zip(takers, [0, *ends], ends):
            load[s] += size * (b - a)
        assert ends[-1] == sizes[size]
    assert sorted(load) == one_by_one(sizes.items(), n)


def test_assign(make_docs):
    texts = [None, "", "a", "a", "é" * 5, "long " * 2000] + ["copy"] * 40 + [f"text {i}" * (i % 7) for i in range(60)]
    docs = make_docs([(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(7, "copy"), (7, "copy")])
    got = sharding.op1_sharding(docs).collect()
    assert len(got) == len(texts) + 2
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        r = by_id[i if i != 3 else None][0]
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    groups = defaultdict(set)
    for r in got:
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in got:
        sizes[r["text_crc32"], r["size"]] += r["size"]
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    want = one_by_one(Counter(sizes.values()).items(), 24)
    assert sorted([*load.values(), *[0] * (24 - len(load))]) == want


def test_empty(make_docs):
    assert rows_of(sharding.op1_sharding(make_docs([]))) == []

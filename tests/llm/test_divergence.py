import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lethe.llm import divergence as dv
from tests.llm.conftest import rows_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=10, top=10):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    found = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    df = Counter((lang, t) for lang, _, w in found for t in set(w))
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].append(t)
    count = defaultdict(Counter)
    for lang, source, w in found:
        count[lang, source].update(t for t in w if df[lang, t] >= least)
    whole = defaultdict(Counter)
    for (lang, _), c in count.items():
        whole[lang].update(c)
    share = lambda c, lang, t: 1 + 10 ** 9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept[lang]))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for (lang, source), c in count.items():
        pair = [(o, sum(f(share(c, lang, t), share(oc, lang, t)) for t in kept[lang]))
                for (ol, o), oc in count.items() if ol == lang and o != source]
        term = [(t, f(share(c, lang, t), share(whole[lang], lang, t))) for t in kept[lang]
                if c[t] and share(c, lang, t) > share(whole[lang], lang, t)]
        for part, items, most in (("pair", pair, None), ("term", term, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, v, r) for r, (i, v) in enumerate(items[:most], 1)]
    return out


@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60))
@settings(max_examples=500, deadline=None)
def test_transducer_numbers_its_words_and_no_others(words):
    words = sorted(w.replace(b"\xff", b"\xfe") or b"a" for w in words)
    words = sorted(set(words))
    t = dv.Transducer(7, *dv.build([b"en\xff" + w for w in words]))
    asked = sorted({*words, *(w + b"x" for w in words), *(w[:-1] for w in words if len(w) > 1), b"?"})
    data = np.frombuffer(b" ".join(asked) + b" ", np.uint8)
    size = np.array([len(w) for w in asked])
    first = np.cumsum(size + 1) - size - 1
    state, number = t.begin("en")
    assert t.begin("de")[0] == -1 and (state >= 0) == bool(words)
    found, ordinals = t.read(data, first, size, np.full(len(asked), state), np.full(len(asked), number))
    assert {asked[i]: o for i, o in zip(found, ordinals)} == {w: 7 + i for i, w in enumerate(words)}


@given(st.sets(st.text("ab", min_size=1, max_size=5), min_size=1, max_size=40))
@settings(max_examples=300, deadline=None)
def test_transducer_is_minimal(words):
    """As many states as there are different sets of endings (the dead one left out)."""
    words = {w.encode() for w in words}
    keys, _, _, final = dv.build(sorted(words))
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    endings = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes}
    assert len(final) == len(endings)
    assert len(set(keys.tolist())) == len(keys)


@pytest.fixture(params=["whole", "small"])
def bounds(request, monkeypatch):
    if request.param == "small":  # several automata in several lots, many tiles, counts handed on early
        for name, value in {"RANGE_BYTES": 30, "SENT_BYTES": 600, "TILE_TERMS": 3, "TILE_SOURCES": 2, "HELD": 4, "PIECE": 64}.items():
            monkeypatch.setattr(dv, name, value)


def made(seed=3, n=240):
    r = random.Random(seed)
    words = ["the", "The", "of", "é", "éa", "naïve", "x", "梦", "a", "ab", "abc", "zz"]
    rows = []
    for i in range(n):
        lang = r.choice(["en", "en", "de", None])
        source = r.choice(["s1", "s2", "S2", "ü", None, "s1"])
        rows.append((" ".join(r.choices(words, k=r.randrange(0, 9))).replace("x ", "x3"), lang, source))
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("bonjour", "fr", None), ("only", "it", "one"), ("tie tie " * 5000, "en", "s1")]
    return rows + [("same words here", "en", "s9")] * 11  # repeated rows


def test_equals_brute_force(make_docs, bounds):
    rows = made()
    docs = make_docs([(i, *r) for i, r in enumerate(rows)])
    got = rows_of(dv.divergence(docs), "lang", "source", "part", "item", "value", "rank")
    assert got == sorted(brute(rows))
    assert {r[2] for r in got} == {"pair", "term"}


def test_no_term_kept_and_empty_table(make_docs):
    rows = [("a b", "en", "s1"), ("b", "en", "s2"), (None, "de", None)]
    docs = make_docs([(i, *r) for i, r in enumerate(rows)])
    assert rows_of(dv.op12_divergence(docs)) == [("en", "s1", "pair", "s2", 0, 1), ("en", "s2", "pair", "s1", 0, 1)]
    assert rows_of(dv.op12_divergence(docs.limit(0))) == []

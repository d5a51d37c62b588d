import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lethe.llm import sentence_pieces as sp
from tests.llm.conftest import rows_of


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=sp.model_path())


@pytest.fixture(scope="module")
def codec():
    return sp.Codec(sp.model_path())


def same(library, codec, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    raw = codec.encode(text)
    assert np.frombuffer(raw, "<u4").tolist() == ids
    assert codec.decode(raw) == library.decode(ids)


PARTS = [" ", "  ", "a", "b", "the", "ing", "▁", "\n", "é", "梦", "€", "😀", "\x00", "͸", "1", "22", "aaaa", "'", "\t",
         "<0x0A>", "<s>", "</s>", "<unk>", "tion", " " * 17]


@given(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(exclude_categories=["Cs"])), max_size=20).map("".join))
@settings(max_examples=1500, deadline=None)
def test_ids_and_text_equal_the_librarys(library, codec, text):
    same(library, codec, text)


@given(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31_999)), max_size=10))
@settings(max_examples=1000, deadline=None)
def test_any_ids_decode_as_in_the_library(library, codec, ids):
    assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


@pytest.mark.parametrize("text", ["x" * 100_000, " " * 200_000, "\n" * 50_000, "梦" * 20_000, "ab" * 40_000, "word " * 30_000,
                                  "ͰͱͲ" * 10_000, "a" * 64, "a" * 65])
def test_long_texts(library, codec, text):
    same(library, codec, text)


def naive(text, scores):
    parts = list(text)
    while True:
        best = max(((scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores), default=None)
        if best is None:
            return parts
        i = -best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@given(st.dictionaries(st.text("abc", min_size=1, max_size=5), st.integers(-4, 4), max_size=25), st.text("abcd", max_size=40))
@settings(max_examples=1500, deadline=None)
def test_prefix_table_is_plain_merging_for_any_scores(scores, text):
    """Also where scores tie, do not follow the order of the merges, or cannot be reached, and
    where a character of a piece is no piece itself."""
    table = sp.PrefixTable({k: float(v) for k, v in scores.items()})
    text = "".join(c for c in text if c in table.known)
    want = naive(text, scores)
    assert table.parts(text) == want
    found, n = table.short_parts([text, "", text[:3]])
    assert [table.pieces[i] for i in found] == want + naive(text[:3], scores)
    assert n.tolist() == [len(want), 0, len(naive(text[:3], scores))]


def test_kept_stretches_and_pairs_may_be_forgotten(library, monkeypatch):
    monkeypatch.setattr(sp, "KEPT", 5)
    monkeypatch.setattr(sp, "PAIR_BITS", 5)
    codec = sp.Codec(sp.model_path())
    for text in ("one two three four five six seven eight", "nine ten one two\nthree", "abracadabra " * 9):
        same(library, codec, text)


def test_other_models_are_refused():
    with pytest.raises(Exception):
        sp.Codec("/no/such/model")


def test_query_rows(library, make_docs):
    texts = [None, "", "one", "one", "Ein Satz.\n\nNoch einer  ", "x" * 3000, "\x00"]
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "two")])
    got = rows_of(sp.op13_sentence_pieces(docs))

    def row(i, t):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        return (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(library.decode(ids).encode()).hexdigest())
    want = [row(i, t) for i, t in enumerate(texts)] + [row(3, "one"), row(None, "two")]
    assert got == sorted(want, key=lambda r: tuple((x is None, x) for x in r))


def test_encode_then_decode_and_empty_table(make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    path = sp.model_path()
    assert rows_of(sp.decode(sp.encode(docs, path), path)) == [(1, "a b"), (2, "")]
    assert rows_of(sp.op13_sentence_pieces(docs.limit(0))) == []

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lethe.llm import packing
from tests.llm.conftest import rows_of


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.tokenizer_path())


@given(t=st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x1c\u0085  'stdmrevl.!1٣"), st.characters(exclude_categories=["Cs"])), max_size=40))
@settings(max_examples=1500, deadline=None)
def test_ids_equal_the_librarys(tokenizer, encoder, t):
    assert encoder.ids(t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_ids_of_special_strings_and_long_texts(tokenizer, encoder):
    for t in ("<|endoftext|>", "a <|endoftext|> b", "word " * 30_000, "x" * 5000, "don't  I'll  they've"):
        assert encoder.ids(t) == tokenizer.encode(t, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
@settings(max_examples=300, deadline=None)
def test_patterns_place_everything_once(histogram):
    packs = packing.patterns(histogram, 64)
    placed = Counter()
    for count, pack in packs:
        assert count > 0 and sum(pack) <= 64
        for length in pack:
            placed[length] += count
    assert placed == Counter(histogram)
    spots = set()
    for length, ends, firsts, offsets, times in packing.places(packs):
        assert ends[-1] == histogram[length]
        begin = 0
        for end, first, offset, k in zip(ends, firsts, offsets, times):
            for i in range(end - begin):
                at = [(first + i // k, offset + i % k * length + j) for j in range(length)]
                assert not spots & set(at)
                spots |= set(at)
            begin = end
    assert len(spots) == sum(k * n for k, n in histogram.items())


def test_little_padding():
    rng = np.random.default_rng(4)
    histogram = Counter(rng.integers(1, 1025, 20_000).tolist())
    packs = packing.patterns(histogram)
    assert sum(k * n for k, n in histogram.items()) / (1024 * sum(c for c, _ in packs)) > 0.97


def test_pack(make_docs, tokenizer):
    rows = [(1, "hello world"), (2, None), (3, ""), (None, "x y z"), (4, "many words here " * 2000), (5, "twice"), (5, "twice"), (5, "not twice")]
    rows += [(100 + i, "filler text " * (i * 7 % 190)) for i in range(150)]
    got = rows_of(packing.op8_packing(make_docs(rows)), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    want = Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), 1024):
            piece = ids[s:s + 1024]
            want[i, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter(r[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r[5]].append((r[6], r[2]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.op8_packing(make_docs([])).collect() == []


@pytest.fixture(scope="module")
def unchanged():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.tokenizer_path())


PARTS = ["<|endoftext|>", "<|endoftext", "|>", "<|", " ", "  ", "\n", "a", "'s", "word", "1", "é", "!"]


@given(st.lists(st.sampled_from(PARTS), max_size=14))
@settings(max_examples=1000, deadline=None)
def test_added_tokens_are_one_id_each(unchanged, encoder, parts):
    t = "".join(parts)
    assert encoder.encode(t) == unchanged.encode(t, add_special_tokens=False).ids


def test_pack_of_added_tokens(make_docs, unchanged):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x<|endoftext|><|endoftext|>  y " * 700), (4, "<|endoftext|")]
    got = rows_of(packing.op8_packing(make_docs(rows)), "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    want = []
    for i, t in rows:
        ids = np.array([*unchanged.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, s, len(ids[s:s + 1024]), zlib.crc32(ids[s:s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024)]
    assert got == want and got[0][4] == 5


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 1_200_000, " \n\t" * 400_000, "\u00a0" * 1_100_000])
def test_very_long_white_space(encoder, run):
    from tokenizers import Tokenizer
    text = "a <|endoftext|>" + run + "b"
    assert encoder.encode(text) == Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids

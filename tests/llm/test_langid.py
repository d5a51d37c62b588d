import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lethe.llm import langid


def partial_matching(text, docs):
    """Bits of ``text`` by escaping (method C, exclusion) from order 3 down, from the definition."""
    follow = defaultdict(Counter)
    for d in docs:
        d = b"\n\n\n" + d
        for i in range(3, len(d)):
            for k in range(4):
                follow[d[i - k:i]][d[i]] += 1
    t, bits = b"\n\n\n" + text, 0.0
    for i in range(3, len(t)):
        out = set()
        for k in (3, 2, 1, 0):
            f = {b: n for b, n in follow.get(t[i - k:i], {}).items() if b not in out}
            if not f:
                continue
            total = sum(f.values()) + len(f)
            if t[i] in f:
                bits -= math.log2(f[t[i]] / total)
                break
            bits -= math.log2(len(f) / total)
            out |= set(f)
        else:
            bits += math.log2(256 - len(out))
    return bits


def test_code_lengths_are_exact():
    langs = [("aa", [b"the cat and the dog", b"that then"]), ("bb", ["être ou ne pas être".encode(), b"le chat"])]
    model = langid.learn(langs)
    for t in (b"", b"the", "être là".encode(), bytes(range(256)), b"the cat " * 30):
        want = [partial_matching(t, d) for _, d in langs]
        assert model.code_lengths([t])[0] == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_long_texts_are_scored_whole():
    model = langid.learn([("aa", [b"abcabd" * 20]), ("bb", [b"xyzxyw" * 20])])
    t = b"abcabd" * 400_000
    piece = model.code_lengths([t[:3]])[0]
    per = (model.code_lengths([t])[0] - piece) / (len(t) - 3)
    short = (model.code_lengths([t[:6000]])[0] - piece) / (6000 - 3)
    assert per == pytest.approx(short, rel=1e-2)


EN = "the {} that was with this other thing and there were they then what which"
FR = "le {} que dans les avec pour une être où elle nous vous sont mais très"


def test_predictions(make_docs):
    rows = [(i, (EN if i % 2 else FR).format(i), "en" if i % 2 else "fr", "s") for i in range(300)]
    rows += [(900, None, "en", "s"), (901, "", "fr", "s"), (902, "12 34 !?", "en", "s"), (None, EN, "en", None), (7, EN, None, "s"), (7, EN, None, "s"),
             (903, FR * 2000, "fr", "s")]
    got = langid.op4_langid(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t, lang, _ in rows:
        r = by[i][0]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if i in (900, 901, 902):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif lang:
            assert r["lang_pred"] == lang
    assert langid.op4_langid(make_docs([])).collect() == []
    assert [r["lang_pred"] for r in langid.op4_langid(make_docs([(1, "text", None, "s")])).collect()] == ["und"]


def test_a_hot_copy_does_not_fill_the_sample(make_docs):
    rows = [(i, EN, "en", "s") for i in range(500)] + [(1000 + i, EN.format(i), "en", "s") for i in range(20)]
    texts = dict(langid.sample(make_docs(rows)))["en"]
    assert len(texts) == len(set(texts)) > 10


def test_keep_known(make_docs):
    rows = [(i, (EN if i % 2 else FR).format(i), "en" if i % 2 else "fr", "s") for i in range(60)]
    docs = make_docs(rows + [(100, "12 34", "en", "s"), (101, None, "en", "s"), (102, "世界" * 60, None, "s"), (103, EN, None, "s")])
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(60), 103]


def test_a_language_without_statistics_codes_every_byte_in_eight_bits():
    model = langid.learn([("aa", []), ("bb", [bytes(range(256)) * 2])])
    assert model.code_lengths([b"abc"])[0][0] == pytest.approx(24.0)
    assert np.isfinite(model.code_lengths([bytes(range(256))[::-1]])).all()


def test_a_language_of_long_texts_alone_is_learnt(make_docs):
    rows = [(i, EN.format(i), "en", "s") for i in range(60)]
    long = {100 + i: " ".join(f"{w} {(i * 7 + n) % 97}" for n in range(1000) for w in "世界 の 言葉 は 長い 文章 です".split()) for i in range(8)}
    assert all(len(t.encode()) > langid.SAMPLE_BYTES for t in long.values())
    docs = make_docs(rows + [(i, t, "ja", "s") for i, t in long.items()])
    assert {r["doc_id"]: r["lang_pred"] for r in langid.op4_langid(docs).collect()} == dict.fromkeys(range(60), "en") | dict.fromkeys(long, "ja")
    assert sorted(r["doc_id"] for r in langid.keep_known(docs).collect()) == [*range(60), *long]
    alone = make_docs([(i, t, "ja", "s") for i, t in long.items()])
    assert {r["lang_pred"] for r in langid.op4_langid(alone).collect()} == {"ja"}


def test_pieces_of_a_long_text_are_spread_over_the_whole(make_docs):
    words = [f"wörter{n:05d} " for n in range(40_000)]
    (lang, got), = langid.sample(make_docs([(0, "".join(words), "de", "s")]))
    assert lang == "de" and len(got) == langid.SAMPLE_PIECES and sum(map(len, got)) <= langid.SAMPLE_BYTES
    text = "".join(words).encode()
    starts = sorted(text.find(p) for p in got)
    part = len(text) // langid.SAMPLE_PIECES
    assert [at // part for at in starts] == list(range(langid.SAMPLE_PIECES))
    whole = "ein kurzer Text"
    assert langid.sample(make_docs([(0, whole, "de", "s")])) == [("de", [whole.encode()])]


def test_random_code_lengths_are_exact():
    rng = np.random.default_rng(5)
    for kinds in (2, 5, 30, 256):
        docs = [bytes(rng.integers(0, kinds, int(n)).astype(np.uint8)) for n in rng.integers(1, 300, 6)]
        model = langid.learn([("aa", docs)])
        for _ in range(10):
            t = bytes(rng.integers(0, min(256, kinds + 2), 80).astype(np.uint8))
            assert model.code_lengths([t])[0][0] == pytest.approx(partial_matching(t, docs), rel=1e-5, abs=1e-5)


def test_every_context_of_every_language_is_kept():
    rng = np.random.default_rng(3)
    docs = {f"l{i:03d}": [bytes(rng.choice(rng.permutation(256)[:90], 20_000).astype(np.uint8))] for i in range(100)}
    model = langid.learn(sorted(docs.items()))
    for tree, (_, (t,)) in zip(model.trees, sorted(docs.items())):
        padded = b"\n\n\n" + t
        assert len(tree.contexts[3]) == len({padded[i:i + 3] for i in range(len(t))})
    assert sum(tree.nbytes() for tree in model.trees) < 100 * 20_000 * 80  # in proportion to the sample
    for lang in ("l000", "l050", "l099"):
        assert model.langs[int(model.code_lengths([docs[lang][0][:300]])[0].argmin())] == lang


def test_a_code_length_does_not_depend_on_its_group(monkeypatch):
    rng = np.random.default_rng(7)
    model = langid.learn([("aa", [b"abcabd" * 20]), ("bb", [b"xyzxyw" * 20])])
    texts = [bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in (0, 1, 5, 700, 3000)]
    monkeypatch.setattr(langid, "PIECE", 256)
    together = model.code_lengths(texts)
    monkeypatch.setattr(langid, "GROUP", 1)
    assert (model.code_lengths(texts) == together).all()
    monkeypatch.setattr(langid, "PIECE", 1 << 18)
    assert model.code_lengths(texts) == pytest.approx(together)


def test_the_pipeline_stage_takes_small_batches(spark):
    """A batch of whole texts is held several times over in each task, so it holds few of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    docs = spark.range(2500).selectExpr("id AS doc_id", "concat('the cat and the dog number ', id) AS text", "'en' AS lang", "'s' AS source", "10L AS n_chars")
    assert langid.keep_known(docs).count() == 2500
    assert int(spark.conf.get(name)) == 1000
    spark.conf.set(name, "100")
    langid.keep_known(docs)
    assert spark.conf.get(name) == "100"
    spark.conf.unset(name)

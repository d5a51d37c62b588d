import corpus_pipeline
from lethe.llm.common import materialize

EN = "the {0} that was with this other thing and there were they then what which of {0} things"
FR = "le {0} que dans les avec pour une être où elle nous vous sont mais très {0} peu"


def test_stages_one_after_another(spark, make_docs):
    rows = [(i, (EN if i % 2 else FR).format(f"w{i} x{i * 7} y{i * 13}") + f" mail u{i}@example.com", "en" if i % 2 else "fr", f"s{i % 3}") for i in range(90)]
    rows += [(1000, rows[5][1], "en", "s1"), (1001, "12 34 56", "en", "s0"), (1002, None, None, None)]
    docs = make_docs(rows, extra=False)
    names, seen = [n for n, _ in corpus_pipeline.STAGES], {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, ""), "test-stage")
        if name != names[-1]:
            assert out.columns == docs.columns
        seen[name] = docs = out
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    assert ids(seen["language"]) == [*range(90), 1000]
    assert ids(seen["near-duplicates"]) == list(range(90))
    clean = seen["personal data"].collect()
    assert all("[EMAIL]" in r["text"] and "@" not in r["text"] and r["n_chars"] == len(r["text"]) for r in clean)
    mixed = ids(seen["mixture"])
    assert set(mixed) <= set(range(90)) and max(mixed.count(i) for i in mixed) <= 3
    pieces = seen["packing"].collect()
    assert sorted(r["doc_id"] for r in pieces if r["start"] == 0) == mixed


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5

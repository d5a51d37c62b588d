import pytest

#: Columns that the operators use inside, here with other contents.
CLASHING = ["Text", "size", "key", "shard", "part", "fp", "src", "rate", "copies", "h", "n", "hash", "id", "_salt", "_c0", "clean"]


@pytest.fixture
def make_docs(spark):
    """documents from (doc_id, text, lang, source) rows, with clashing extra columns."""
    def make(rows, extra=True):
        rows = [(*r, *[None, "en", "s"][len(r) - 1:])[:4] if len(r) < 4 else r for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(*r, None if r[1] is None else len(r[1])) for r in rows]
        if extra:
            schema += "".join(f", `{c}` string" for c in CLASHING)
            full = [(*r, *["x"] * len(CLASHING)) for r in full]
        return spark.createDataFrame(full, schema)
    return make


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "Doc string, kept boolean, __sha string, size long, label string, bands string, copies int"


@pytest.fixture
def make(spark):
    """rows of (doc_id, text, lang, source) as documents, optionally with columns whose names clash with inner ones."""

    def f(rows, clash=False):
        rows = [(*r[:4], len(r[1]) if r[1] is not None else None) for r in ((*r, None, None)[:4] for r in rows)]
        if clash:
            return spark.createDataFrame([(*r, "x", True, "y", 7, "l", "b", 3) for r in rows], f"{SCHEMA}, {CLASHING}")
        return spark.createDataFrame(rows, SCHEMA)

    return f

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A frame of documents from texts, or from (doc_id, text, source)."""

    def make(*rows):
        full = [row if isinstance(row, tuple) else (i, row, "src0") for i, row in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in full], DOCS)

    return make


@pytest.fixture
def clashing():
    """Adds columns whose names the operators use themselves."""

    def add(df):
        names = "size shard slot start length ids bucket row word key id n form spans score n_words _row _pos".split()
        return df.selectExpr("*", *(f"'x' AS {name}" for name in names))

    return add

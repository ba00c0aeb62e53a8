import pytest

from rubrica.llm.common import prepared

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, copies int, row int, comp string"


@pytest.fixture
def llm(spark):
    return prepared(spark)


@pytest.fixture
def docs(llm):
    """Builds a table of documents that also carries columns with the operators' own names."""

    def build(texts, ids=None, langs=None, sources=None):
        n = len(texts)
        rows = [
            (i, t, lang, s, None if t is None else len(t), "x", 1, 2, "y")
            for i, t, lang, s in zip(ids or range(n), texts, langs or [None] * n, sources or [None] * n, strict=True)
        ]
        return llm.createDataFrame(rows, DOCS)

    return build


def rows(df):
    return [tuple(r) for r in df.collect()]

import pytest

from spendweave.llm.common import ready


@pytest.fixture(scope="session")
def llm(spark):
    return ready(spark)


@pytest.fixture
def documents(llm):
    """A documents table from (doc_id, text) rows, with null columns and a column that has a name used inside."""

    def make(rows, lang=None):
        rows = [(i, t, lang[k] if lang else None, None, None if t is None else len(t), "mine") for k, (i, t) in enumerate(rows)]
        return llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n string")

    return make

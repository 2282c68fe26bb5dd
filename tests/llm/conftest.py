import pytest

from roadpulse.llm.common import prepare


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(llm):
    """Documents from (doc_id, text) pairs, with columns whose names clash with
    the operators' own."""

    def make(rows, parts=3):
        full = [(i, t, "en", None, None if t is None else len(t), "x", 7, -1) for i, t in rows]
        return llm.createDataFrame(full, DOC_SCHEMA + ", shard string, fp long, kept int").repartition(parts)

    return make

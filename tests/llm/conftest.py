import pytest

from codeloom.llm.common import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)
    return spark


@pytest.fixture()
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names the operators use inside."""

    def make(rows):
        rows = [(i, t, "en", "s", 1, "x", "y", 2, 3, "w") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, words string, size bigint, sig bigint, spans string")

    return make

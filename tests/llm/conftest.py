import pytest


@pytest.fixture(scope="session")
def llm(spark):
    from tavola.llm.shared import ship_package
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def docs_of(llm):
    """Documents of (doc_id, text) pairs with the other columns, and one of a clashing name."""
    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t), "x") for i, t in rows]
        return llm.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    return make

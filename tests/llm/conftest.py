import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with a column more than the operators know."""
    def make(*rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or ""), "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, digest string")
    return make

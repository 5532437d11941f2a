import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from rows (doc_id, text, source), with the other columns of the table."""
    def make(rows):
        rows = [(*r, None)[:3] if len(r) < 3 else r for r in rows]
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows],
                                     "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make


@pytest.fixture(scope="session")
def small_docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")

import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from texts; extra columns have names that results use too."""

    def make(texts, **extra):
        rows = [(i, t, "en", f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        return df

    return make

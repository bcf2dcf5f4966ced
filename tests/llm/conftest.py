import pytest


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text, lang, source) as a documents table."""

    def build(rows):
        rows = [(*r, *("en", "s")[len(r) - 2:]) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    return build

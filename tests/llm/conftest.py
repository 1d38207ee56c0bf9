import pytest


@pytest.fixture
def docs_of(spark):
    """Documents with a clashing extra column, from (doc_id, text) or (doc_id, text, lang) rows."""

    def make(rows):
        rows = [(*r, None)[:3] for r in rows]
        out = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        return out.selectExpr("doc_id", "text", "lang", "'x' AS source", "1L AS n_chars", "'clash' AS kept", "0 AS name", "0 AS fp", "0 AS _group")

    return make

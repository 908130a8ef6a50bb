import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def docs(spark):
    """Rows of (doc_id, text), with columns whose names clash with what the operators use inside."""
    def make(rows):
        extra = "quality string, url_rule string, pieces string, pii string, secrets string, key string, n long, text_hash long, word string"
        return spark.createDataFrame([(i, t, *["x"] * 6, 1, 2, "y") for i, t in rows], "doc_id long, text string, " + extra)
    return make

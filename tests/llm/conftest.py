import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, `row` int, part int, spans string"


@pytest.fixture
def docs(spark):
    """Documents with columns whose names the operators use themselves."""
    return lambda *rows: spark.createDataFrame([(i, t, "en", "s", 1, "k", 7, 8, "x") for i, t in rows], SCHEMA)

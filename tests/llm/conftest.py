import pytest
from texts import corpus


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    wide = [(i, t, "en", "s", len(t or ""), b"z", True, 1, "k") for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, digest binary, kept boolean, id int, text_key string").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")

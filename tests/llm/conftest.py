import pytest

from riskloom.sources import shared

EDGES = [None, "", " ", "\n\n", "one", "two words", "ärger über ß", "▁ a ▁", "日本 語", "x" * 3000, "a b " * 2000]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    shared.ship(spark)


@pytest.fixture
def docs(spark):
    """Rows with every edge case, some twice, and columns whose names clash with the operators' own."""
    rows = [(k, t, "en" if k % 2 else None, "s", "kept as it is", 7) for k, t in enumerate(EDGES * 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, note string, band int")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")

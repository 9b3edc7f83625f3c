import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, words string, h long, gram string"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and long texts, repeated rows, ties, and extra columns whose names operators use inside."""
    long = " ".join(f"the er{k % 97}on ofth{k % 13}" for k in range(20_000))
    prose = "That and onesen erblest it hein ti inenan eranenes whou therouou thon the. Than heoron eratsh therin blees sh in esheon"
    texts = [(1, prose), (2, prose), (2, prose), (3, None), (4, ""), (5, "   \n\t "), (6, long), (None, prose + " end"), (7, "\0 ퟿ é日本 ▁▁ <|endoftext|> a\r\nb"), (8, "one"), (9, "1 2 3 4 5 6"), (10, prose.upper())]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None, None, "k", "w", 1, "g") for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

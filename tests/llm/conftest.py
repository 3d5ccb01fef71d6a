import pytest

LONG = " ".join(f"word{i % 997} x{i % 31}," for i in range(30_000))
#: Nulls, empty and very long texts, repeated rows, and ties.
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, "a b", None), (3, "a b", None), (4, "A  b", "de"), (None, "no id here 4111 1111 1111 1111", "en"), (None, "no id here 4111 1111 1111 1111", "en"),
    (5, LONG, "en"), (6, LONG + " tail", "en"), (7, "\n\n \t", "fr"), (8, "éàü ß 漢字 😀 <|endoftext|> don't\r\n", "fr"), (9, "12 +49 (30) 123-4567 10.0.0.1 a.b@c.de a.b", "en"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Edge cases, with extra columns whose names clash with those that operators compute."""
    rows = [(*r, "s", 1, 2, 3, "x", "y") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, id long, key string, rank string").cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")

import pytest

from brute import SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    rows = [
        (1, None, "en", None), (2, "", None, "a"), (3, " \n\t ", "en", "a"), (4, "x", "en", "b"), (5, "!!! --- ???", "en", "b"), (6, "日本語 テキスト の 文 です 。", None, "a"),
        (7, "one two three four five six seven", "en", "a"), (7, "one two three four five six seven", "en", "a"), (None, "one two three four five six seven", "en", "a"),
        (8, "It's <|endoftext|>  naïve  café́ İ \n\n x", "fr", "a"), (9, "word " * 30_000, "en", "a"), (10, "a@b.co +1 (555) 555-5555 4111 1111 1111 1111 1.2.3.4 " * 40, "en", "a"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

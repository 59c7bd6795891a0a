import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, shard int, component_id long, "
          "canonical string, words string, n_words long")


@pytest.fixture(scope="module")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns that clash with results."""
    long = "word " * 60_000 + "end"
    texts = [(1, "one two three four"), (1, "one two three four"), (2, None), (3, ""), (4, " \n\t "), (None, "one two three four"),
             (5, long), (6, "é ü 漢字 \x00 x"), (7, "one two three four"), (None, None), (8, "a" * 250_000)]
    rows = [(key, text, None if at % 2 else "en", None if at % 3 else "s", None, 1.0, 9, 9, "x", None, None)
            for at, (key, text) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

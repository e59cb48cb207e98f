import pytest

LONG = "lorem ipsum dolor " * 9000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, equal ids, an extra column with a clashing name."""
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 44, "x"),
        (2, "The CAT sat on the mat and looked at the dog", "en", "a", 44, "y"),
        (2, "The CAT sat on the mat and looked at the dog", "en", "a", 44, "y"),
        (3, None, None, None, None, None),
        (4, "", "en", "b", 0, ""),
        (5, " \t\n ", None, "b", 4, "z"),
        (None, "a row without an id", "en", None, 19, "n"),
        (None, None, None, None, None, None),
        (7, LONG, "la", "b", len(LONG), "long"),
        (8, "naïve  Ünïcode\n\n text 12345 <|endoftext|> !!", "de", "c", 40, "u"),
        (9, "word", "en", "c", 4, "w"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, {} string"
    return lambda extra="fp": spark.createDataFrame(rows, schema.format(extra))

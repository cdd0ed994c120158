import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, matches string"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with the operators' own names."""
    long_text = "lorem ipsum dolor sit amet\n" * 4000
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "b", 1, 0.5, 1, "x"),
        (1, "Alpha beta gamma delta epsilon zeta", "en", "b", 1, 0.5, 1, "x"),
        (2, "", "en", None, 0, None, None, None),
        (3, None, None, "a", None, None, None, None),
        (None, "Alpha beta gamma delta epsilon zeta", None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None),
        (4, long_text, "fr", "a", 5, 0.1, 2, "y"),
        (5, " \t\n\x0b ", "fr", "c", 5, 0.1, 2, "y"),
        (6, "12 34 !? 56", "fr", "c", 5, 0.1, 2, "y"),
        (7, "naïve façade œuvre 中文 🎉 text", "fr", "é", 5, 0.1, 2, "y"),
    ]
    return spark.createDataFrame(rows, DOCS)

import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, ties, and an extra column with a clashing name."""
    long = "lorem ipsum " * 4000 + "end."
    rows = [
        (1, None, "en", "src1", None, "x"),
        (2, "", None, "src2", 0, "x"),
        (3, long, "en", None, len(long), "x"),
        (4, "same text here", "en", "src1", 14, "x"),
        (4, "same text here", "en", "src1", 14, "x"),
        (5, "same text here", "fr", "src1", 14, None),
        (6, "<|endoftext|> and <|startoftext|> éè \U0001f600 a\x1cb", "en", "src0", 40, "x"),
        (None, "no id at all", "en", "src0", 12, "x"),
        (7, "a" * 5000 + " 1" * 3000, "en", "src0", None, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length string")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, None, 1), (2, 1, None), (None, 0, 0), (4, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")

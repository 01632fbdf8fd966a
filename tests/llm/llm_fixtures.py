import datetime

import pytest


@pytest.fixture
def odd_documents(spark):
    """NULLs in every column, an empty and a very long text, repeated rows,
    and extra columns named like outputs and helpers."""
    long_text = " ".join(f"word{i % 977} Über-{i % 31}" for i in range(60_000))
    rows = [
        (1, "The cat sat on the mat.\nThe cat sat on the mat.", "en", "a"),
        (1, "The cat sat on the mat.\nThe cat sat on the mat.", "en", "a"),
        (2, "the cat sat on the mat the cat sat", None, None),
        (3, "", "en", "b"),
        (4, None, None, "b"),
        (None, "no id here", "en", None),
        (5, long_text, "de", "a"),
        (6, long_text, "de", "c"),
        (7, " \t\n\x0b\x0c\r ", "en", "c"),
        (8, "1234 !!! 😀 日本語 ▁ <|endoftext|> it's we'll", "ja", "c"),
    ]
    day = datetime.date(2024, 1, 1)
    full = [(*r, 7, "x", 0.5, day, "y", 3) for r in rows]
    return spark.createDataFrame(
        full, "doc_id long, text string, lang string, source string, n_tokens int, ids string, score double, "
              "fp date, component_id string, size int")


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.where("false")
